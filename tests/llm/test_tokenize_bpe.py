import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessergrid.llm import tokenize_bpe as B

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n\t'é漢.! 　😀", max_size=200), st.integers(1, 30))
def test_parts_encode_as_the_whole(text, most):
    enc = B.encoding(RANKS, PATTERN)
    cut = B.parts(text, most)
    assert "".join(cut) == text
    assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_round_trip_and_digests(spark, odd):
    enc = B.encoding(RANKS, PATTERN)
    want = sorted((str(r.doc_id), len(i := enc.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    rows = B.token_digests(odd, RANKS, PATTERN, with_ids=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert all(len(r.ids) == r.n_tokens for r in rows)
    assert B.token_digests(odd.limit(0), RANKS, PATTERN).count() == 0


def test_encode_then_decode(spark, odd):
    both = B.decode_ids(B.encode_texts(odd, RANKS, PATTERN), RANKS, PATTERN)
    assert both.where(F.coalesce("text", F.lit("")).cast("binary") != F.col("decoded")).count() == 0
    cut = spark.createDataFrame([(B.encoding(RANKS, PATTERN).encode_ordinary("漢")[:1],), (None,)], "ids array<int>")
    assert [bytes(r.decoded) for r in B.decode_ids(cut, RANKS, PATTERN).collect()][1] == b""


def test_long_text():
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "x", "  \n", "9", "é"]) for _ in range(200_000))
    assert len(B.parts(text)) > 1
    assert B.encode(B.encoding(RANKS, PATTERN), text) == B.encoding(RANKS, PATTERN).encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" ", "\n", "\t ", "é", "ab", "1", "!", "\u3000"]), st.integers(1, 12)), max_size=8))
def test_long_runs_are_pieces(runs):
    """With a limit of four characters for what goes to the matcher, ids are those of the whole."""
    text = "".join(x * n for x, n in runs)
    enc, kept = B.encoding(RANKS, PATTERN), (B.LONG_RUN, B._SPACES)
    B.LONG_RUN, B._SPACES = 4, __import__("regex").compile(r"\s{4,}+")
    try:
        assert B.encode(enc, text) == enc.encode_ordinary(text)
    finally:
        B.LONG_RUN, B._SPACES = kept


def test_millions_of_blanks():
    enc = B.encoding(RANKS, PATTERN)
    for text in (" " * 3_000_000, "a" + "\n" * 2_000_000 + "b", "x " + "\t " * 1_000_000 + "!"):
        assert enc.decode_bytes(B.encode(enc, text)) == text.encode()
