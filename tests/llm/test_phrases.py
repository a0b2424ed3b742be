import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessergrid.llm import packs as K
from tessergrid.llm import phrases as P


def expected(rows, least=10, most=3, percent=50, top=2000):
    """rows of (text, lang)"""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    key = lang, tuple(w[i : i + m])
                    f[key] = f.get(key, 0) + 1
    kept = {}
    frequent = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in frequent.items():
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if any(len(v) > len(w) and g == lang and inside(v) and 100 * b >= percent * a for (g, v), b in frequent.items()):
            continue
        s, _, l, r = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        kept.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((g, k, p.decode(), -a, l, r, n[g], -s) for g, x in kept.items() for k, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def got(frame):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(4)
    say = lambda k: "".join(rng.choice(["the Cat sat ", "the cat ", "on a mat. ", "é\tß ", "x ", "y; ", "New York City ", "\x00 ", "no  way\n"]) for _ in range(k))
    rows = [(i, say(rng.randint(0, 60)), rng.choice(["en", "de", None, "en"])) for i in range(90)]
    rows += [(90, None, "en"), (91, "", "fr"), (92, "a a a a a a a a a a a a a", "fr"), (None, say(30), "en"), (3, say(10), "en"), (3, say(10), "en")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).cache()


@pytest.mark.parametrize(("least", "most", "percent", "top"), [(10, 3, 50, 2000), (3, 3, 90, 7), (4, 5, 30, 2000), (2, 2, 50, 2000)])
def test_brute_force(some, least, most, percent, top):
    rows = [(r.text, r.lang) for r in some.collect()]
    want = expected(rows, least, most, percent, top)
    assert want and got(P.collocations(some, least=least, most_words=most, share_percent=percent, top=top)) == want


def test_awkward_rows(odd):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert got(P.collocations(odd)) == expected(rows)
    assert P.collocations(odd.limit(0)).count() == 0
    assert P.collocations(odd.where("text is null")).count() == 0


def test_long_texts_are_cut_with_overlap(spark, some, monkeypatch):
    """Pieces of a hundred bytes in packs of a thousand give the counts of whole texts."""
    rows = [(r.text, r.lang) for r in some.collect()]
    small = lambda it, gap, more: K.packs(it, gap, more, most=1000, cut=100)
    monkeypatch.setattr(P, "packs", small)
    import pyarrow as pa

    class Here:
        @staticmethod
        def get():
            return type("C", (), {"partitionId": lambda self: 0})()

    monkeypatch.setattr(P, "TaskContext", Here)
    batch = pa.RecordBatch.from_pydict({"body": [t for t, _ in rows], "lang": [g or "und" for _, g in rows]})
    made = pa.Table.from_batches(list(P._first(iter([batch]), 3)))
    words, texts = made.filter(pa.compute.field("word").is_valid()), made.filter(pa.compute.field("seq").is_valid())
    counted, pairs = Counter(), Counter()
    spelled = {}
    for r in words.to_pylist():
        counted[r["lang"], r["word"]] += r["n"]
        spelled[r["pack"], r["code"]] = r["lang"], r["word"]
    for k in range(texts.num_rows):
        number = texts.column("pack")[k].as_py()
        codes = sorted(c for p, c in spelled if p == number)
        two = P._pairs(texts.slice(k, 1), pa.table({"code": pa.array(codes, pa.int32()), "name": pa.array(codes, pa.int64())}))
        for r in two.to_pylist():
            if r["seq"] is None:
                pairs[*spelled[number, r["a"]], spelled[number, r["b"]][1]] += r["n"]
    assert texts.num_rows > 10
    want1, want2 = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            want1.update((lang or "und", x) for x in w)
            want2.update((lang or "und", *x) for x in zip(w, w[1:]))
    assert counted == want1 and +pairs == want2


def test_scores_are_exact(spark):
    big = 10**12
    rows = [(a, left, right) for a in (10, 333_333_333_333, big - 1, big) for left, right in ((a, a), (a + 1, a), (big, big), (3 * a, 7 * a + 1))]
    out = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").withColumn("s", P._score(F.col("a"), F.col("l"), F.col("r")))
    assert [r.s for r in out.collect()] == [1_000_000 * a * a // (left * right) for a, left, right in rows]


def test_sql(same):
    same("op12_phrases")
