import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessergrid.llm import packs as K
from tessergrid.llm import window_dedup as W


def expected(rows, length=20):
    """rows of (id, text): whatever has a smaller (id, place) twin goes."""
    first, split = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for p in range(len(w) - length + 1):
                x = tuple(w[p : p + length])
                first[x] = min(first.get(x, (i, p)), (i, p))
    out = []
    for i, w in split:
        lost = [False] * len(w)
        if i is not None:
            for p in range(len(w) - length + 1):
                if first[tuple(w[p : p + length])] < (i, p):
                    lost[p : p + length] = [True] * length
        out.append((str(i), len(w), sum(lost), hashlib.sha256(b" ".join([x for x, g in zip(w, lost) if not g])).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_brute_force(spark, odd):
    assert got(W.window_report(odd)) == expected(rows_of(odd))
    assert got(W.window_report(odd, length=3)) == expected(rows_of(odd), 3)


def test_overlaps_within_and_across_documents(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(40)}" for _ in range(120)]
    join = " ".join
    texts = [join(base), join(base[5:30]), "\t".join(base[40:60]) + "\n" + join(base[50:75]), join(base[:19]), join(base[:20] * 3), "x " * 70, join(base[90:]) + " tail", join(base[:20] + ["y" * 200] * 25), join(["y" * 200] * 25)]
    docs = spark.createDataFrame([(20 - i if i < 3 else i + 30, t) for i, t in enumerate(texts)] + [(7, join(base[20:60])), (7, join(base[10:50]))], "doc_id bigint, text string").repartition(5)
    for length in (1, 2, 5, 20):
        assert got(W.window_report(docs, length=length)) == expected(rows_of(docs), length)


def test_kept_text_and_clashing_names(spark):
    shared = " ".join(f"s{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"a {shared} b", 1, 2, 3), (2, f"c {shared} d", 1, 2, 3)], "doc_id bigint, text string, lost_id int, LOST_ROW int, kept int")
    out = {r.doc_id: r for r in W.remove_windows(docs).collect()}
    assert (out[1].kept, out[2].kept, out[2].lost_id, out[2].LOST_ROW) == (f"a {shared} b", "c d", 1, 2)


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(4000))
    for more in (0, 1, 19):
        found = list(K.pieces(text.encode(), W.GAP, more, most=1000))
        words, at = text.split(), 0
        assert len(found) > 10
        for start, own, end, before in found:
            mine, whole = text[start:own].split(), text[start:end].split()
            assert before == at and words[at : at + len(whole)] == whole and len(whole) in (len(mine) + more, len(words) - at)
            at += len(mine)
        assert at == len(words)
    batch = [__import__("pyarrow").RecordBatch.from_pydict({"body": [text, None, "a b", text[500:3000]], "id": [1, 2, 3, 4]})]
    made = list(K.packs(iter(batch), W.GAP, 19, most=3000, cut=1000))
    assert len(made) > 5 and all(len(p.raw) < 5000 for p in made)
    seen = [(int(p.rows.column("id")[r].as_py()), int(p.before[r] + w)) for p in made for found in [W.Windows(p.raw, p.offsets, 20)] for r, w in zip(found.row, found.place)]
    assert sorted(seen) == [(1, k) for k in range(4000 - 19)] + [(4, k) for k in range(len(text[500:3000].split()) - 19)]


def test_sketch_never_loses_a_repeated_window(spark):
    """Whatever its width, both rows answer true for every window that occurs twice."""
    rng = np.random.default_rng(1)
    raw = np.frombuffer(" ".join(f"w{x}" for x in rng.integers(0, 3, 3000)).encode(), np.uint8)
    found = W.Windows(raw, np.array([0, len(raw)]), 5)
    _, number, count = np.unique(found.hash, return_inverse=True, return_counts=True)
    assert (count > 1).any()
    for bits in (16, 20):
        for cells in found.cells(bits):
            assert (np.bincount(cells)[cells] >= count[number]).all()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert W.window_report(none).count() == 0
    assert W.window_report(spark.createDataFrame([(1, None), (None, "a " * 50)], "doc_id bigint, text string")).agg(F.sum("n_removed")).first()[0] == 0


def test_sql(same):
    same("op11_repeated_windows")
