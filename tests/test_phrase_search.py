"""Phrases in texts against trying every place."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessergrid.operators import phrase_search as P

TEXTS = [(1, "a b a b a"), (2, "a a a a"), (3, ""), (4, None), (5, "b c d e"), (6, "c"), (6, "a b"), (7, " ".join(["x"] * 50_000 + ["a", "b", "c"])), (8, "é b")]
PHRASES = ["a b", "a b a", "a", "a a", "b c d e f", "c d", "zz", "", None, "a b", "é b", "a b c", "x x a"]


def brute(texts, phrases):
    out = []
    for key, text in texts:
        w = (text or "").split()
        for p in {p for p in phrases if p}:
            s = p.split(" ")
            out += [(key, p, i) for i in range(len(w) - len(s) + 1) if w[i : i + len(s)] == s]
    return sorted(out)


@pytest.mark.parametrize("sent", [P.SENT, 0])
def test_places(spark, sent):
    texts = spark.createDataFrame(TEXTS, "key int, text string").withColumn("phrase", F.lit("an extra column"))
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    assert sorted(map(tuple, P.phrase_places(texts, "key", words, phrases, sent).collect())) == brute(TEXTS, PHRASES)
    want = {}
    for key, phrase, _ in brute(TEXTS, PHRASES):
        want.setdefault(phrase, []).append(key)
    got = P.phrase_counts(texts, "key", words, phrases, sent).collect()
    assert sorted(map(tuple, got)) == sorted((p, len(set(k)), len(k)) for p, k in want.items())


@pytest.mark.parametrize("sent", [P.SENT, 0])
def test_empty_tables(spark, sent):
    texts, phrases = spark.createDataFrame(TEXTS, "key int, text string"), spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    words = F.split("text", " ")
    assert P.phrase_places(texts.limit(0), "key", words, phrases, sent).count() == 0
    assert P.phrase_places(texts, "key", words, phrases.limit(0), sent).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), min_size=1, max_size=8))
def test_trie(texts, phrases):
    import pyarrow as pa

    spelled = sorted({" ".join(p) for p in phrases})
    trie = P.Trie([p.split(" ") for p in spelled])
    got = [(int(r), spelled[p], int(i)) for rows, places, found in trie.places(pa.array(texts, pa.list_(pa.string()))) for r, i, p in zip(rows, places, found)]
    assert sorted(got) == brute([(i, " ".join(t)) for i, t in enumerate(texts)], spelled)
