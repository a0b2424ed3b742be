import hashlib

import numpy as np
import pytest

from tessergrid.llm import decontaminate as D
from tests.conftest import DATA
from tests.llm.conftest import words


def expected(docs, items, window=10):
    found = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)):
            if w and item is not None:
                found.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(k) for k in found}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in found:
                    hit.update(range(i, i + size))
                    names |= found[k]
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in frame.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_brute_force(spark, odd, block_bytes):
    text = {r.doc_id: r.text for r in odd.collect()}
    items = [(1, text[6]), (2, " ".join(text[10].split()[500:530])), (10, "one two"), (3, None), (4, ""), (None, text[6]), (1, text[6]), (5, "absent words only here")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = D.leak_report(odd, bench, block_bytes=block_bytes)
    assert got(frame) == expected([(r.doc_id, r.text) for r in odd.collect()], items)


def test_longest_matches_and_removal(spark):
    docs = spark.createDataFrame([(1, "z a b c d e f g h i j k l y"), (2, "a b c d e f g h i")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "q a b c d e f g h i j k l r")], "item_id bigint, text string")
    row = D.find_leaks(docs, bench).where("doc_id = 1").first()
    assert max((m.n_words, -m.item_word, m.doc_word) for m in row.leak_matches) == (12, -1, 1)
    assert [(s.first, s.last) for s in row.leak_spans] == [(1, 12)]
    assert [r.doc_id for r in D.remove_leaked(docs, bench).collect()] == [2]


@pytest.mark.parametrize("window", [1, 3, 10])
def test_every_document_has_its_own_longest_matches(spark, window):
    rng = np.random.default_rng(5)
    leak = [f"w{i}" for i in range(14)]
    docs = [(i, " ".join([f"x{i}"] * i + leak[i % 4 :] + ["gap", *leak[:11]])) for i in range(9)] + [(20 + i, " ".join(rng.choice(["a", "b"], 30))) for i in range(5)] + [(40, "w3"), (41, None)]
    items = [("p", " ".join(["q", *leak, "r"])), ("q", " ".join(leak[2:9])), ("s", " ".join(rng.choice(["a", "b"], 25))), ("t", "w3")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = D.find_leaks(frame, bench, window=window).collect()
    for r in rows:
        d, want = words(r.text), {}
        for name, text in items:
            w = words(text)
            for i in range(len(w)):
                for j in range(len(d)):
                    n = next((k for k in range(len(w) - i) if j + k == len(d) or w[i + k] != d[j + k]), len(w) - i)
                    if n >= min(len(w), window) and n > want.get((name, i), (0, 0))[1]:
                        want[name, i] = j, n
        assert {(m.item_id, m.item_word): (m.doc_word, m.n_words) for m in r.leak_matches} == want and len(r.leak_matches) == len(want)
    assert all(r.contaminated == (r.longest_match > 0) for r in D.leak_report(frame, bench, window=window).collect())


def test_empty_tables(spark, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.leak_report(odd, none).where("contaminated").count() == 0
    assert D.leak_report(odd.limit(0), none).count() == 0
    assert D.remove_leaked(odd, none).columns == odd.columns and D.remove_leaked(odd, none).count() == odd.count()


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    for _ in range(20):
        ids = rng.integers(0, 4, 40)
        order = D.suffix_array(ids, 64)
        assert [ids[i:].tolist() for i in order] == sorted(ids[i:].tolist() for i in range(40))


def test_sql(same):
    same("op1_decontaminate")


def test_sample_data(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    docs, bench = read("documents"), read("benchmark")
    assert got(D.leak_report(docs, bench)) == expected([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_several_blocks_with_clashing_columns(spark, odd):
    text = {r.doc_id: r.text for r in odd.collect()}
    bench = spark.createDataFrame([(1, text[6]), (2, " ".join(text[10].split()[500:530])), (3, "one two")], "item_id bigint, text string")
    names = ["_n_hit", "_leak_items", "__leak_spans", "_text", "leak"]
    clash = odd.withColumns({n: odd.source for n in names})
    found = D.find_leaks(clash, bench, block_bytes=200)
    assert set(clash.columns) <= set(found.columns) and {r.doc_id for r in found.where("n_hit > 0").collect()} == {r.doc_id for r in D.find_leaks(odd, bench).where("n_hit > 0").collect()}
    assert D.remove_leaked(clash, bench, block_bytes=200).columns == clash.columns


def test_a_long_item_takes_little_memory(spark):
    import random
    import tracemalloc

    rng = random.Random(3)
    long_ = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    tracemalloc.start()
    D._Matcher(D.load_benchmark([("1", long_)], 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    docs = spark.createDataFrame([(1, "x " + " ".join(long_.split()[7000:12_000]) + " y"), (2, "w1 w2 w3")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, long_)], "item_id bigint, text string")
    rows = {r.doc_id: (r.n_hit, r.longest_match) for r in D.leak_report(docs, bench).collect()}
    assert rows == {1: (5000, 5000), 2: (0, 0)}
