import random

import numpy as np
import pytest

from tessergrid.llm import near_duplicates as N
from tests.conftest import DATA
from tests.llm.conftest import words


def grams(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    sets = {i: grams(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(ids, 0)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (find(i), links[i]) for i in ids}


def got(frame):
    return {r.doc_id: (r.class_id, r.n_links) for r in frame.collect() if r.doc_id is not None}


@pytest.mark.parametrize("block", [1024, 4])
def test_groups_of_near_copies(spark, block):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(150)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[0][1]) for i in range(4)] + [(200 + i, " ".join(f"u{rng.randrange(999)}" for _ in range(60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(N.near_duplicates(docs, block=block)) == expected(rows)


def test_odd_rows(spark, odd):
    frame = N.near_duplicates(odd)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert frame.count() == len(rows)
    assert got(frame) == expected(dict(rows).items())
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2
    assert N.near_duplicates(odd.limit(0)).count() == 0


def test_sample_data(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert got(N.near_duplicates(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_bands():
    bands, rows = N.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 96


def test_shared_counts():
    rng = np.random.default_rng(0)
    has = rng.random((50, 30)) < rng.random(30)
    m, i = np.nonzero(has)
    want = (has.astype(int) @ has.T).astype(float)
    got = N._shared(m, i, 50)
    off = ~np.eye(50, dtype=bool)
    assert (got[off] == want[off]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in N.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: v for k, v in root.items() if k in touched and k != v}


def test_sql(same):
    same("op10_ngram_join")


def test_keep_one_with_clashing_names(odd):
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
