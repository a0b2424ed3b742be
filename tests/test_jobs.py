import logging
import random
import time
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import index_texts, publish_ledger
from jobs.registered import JOB2_SQL
from tessergrid.operators.text_index import TextIndex
from tessergrid.plans import retrieval
from tessergrid.session import shared_folder
from tests.conftest import DATA, table_of

WORDS = "ab cd ef gh ij kl mn op qr st".split()
MOST = 10_000  # bytes of shuffles that a step of the ledger may find


def counted(rows):
    """{(term, doc_id): (tf, dl)} of {doc_id: text}."""
    out = {}
    for i, t in rows.items():
        words = t.split()
        for w, n in Counter(words).items():
            out[w, i] = n, len(words)
    return out


def held(index):
    return {(r.term, r.doc_id): (r.tf, r.dl) for r in index.postings().collect()}


def write(spark, folder, rows):
    spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(folder)


def texts(seed, ids):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, k=rng.randint(1, 12))) for i in ids}


def test_index_takes_only_what_is_new(spark, tmp_path, caplog, monkeypatch):
    caplog.set_level(logging.INFO)
    docs, index, mark = (str(tmp_path / x) for x in ("docs", "index", "mark"))
    rows = texts(1, range(60))
    write(spark, docs, rows)
    run = lambda: index_texts.run(spark, docs, index, mark, buckets=4, unicode=False)
    assert held(run()) == counted(rows)
    first = sorted((tmp_path / "index").rglob("part-*"))
    assert held(run()) == counted(rows) and sorted((tmp_path / "index").rglob("part-*")) == first
    assert "read 60 rows" in caplog.text and "read 0 rows" in caplog.text
    # new documents, changed ones, and one that comes again as it was; the first try is cut short
    later = texts(2, range(50, 90)) | {3: rows[3]}
    write(spark, docs, later)
    bury = TextIndex._bury

    def fails(self, *_):
        raise RuntimeError("lost")

    monkeypatch.setattr(TextIndex, "_bury", fails)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(TextIndex, "_bury", bury)
    made = run()
    assert held(made) == counted(rows | later)
    assert 3 not in {r.doc_id for r in made.table("texts").where("batch = 1").collect()}


def test_search_opens_few_blocks_and_equals_a_full_scan(spark, tmp_path):
    rng = random.Random(3)
    rows = {i: " ".join(rng.choices(WORDS, k=rng.randint(20, 60))) for i in range(6000)}
    for i in (17, 2900, 5000):
        rows[i] = "rare rare ab"
    docs = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    index = TextIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(docs, 0)
    full = retrieval.bm25(docs, "doc_id", "text", ["rare", "ab"]).orderBy(F.round("rank", 9), "doc_id").limit(3)
    near = lambda found: [(r.doc_id, round(r["rank"], 8)) for r in found.collect()]
    assert near(index.search(["rare", "ab"], 3)) == near(full)
    assert index.opened[0] <= 4 < 20 <= index.opened[1]
    index.add(docs, 0)  # a batch again
    assert near(index.search(["rare", "ab"], 3)) == near(full)
    index.remove(spark.createDataFrame([(17,), (None,)], "doc_id bigint"), 1)
    index.add(spark.createDataFrame([(5000, "cd"), (7000, None), (None, "rare"), (8000, "rare")], "doc_id bigint, text string"), 2)
    left = rows | {5000: "cd", 7000: "", 8000: "rare"}
    del left[17]
    now = spark.createDataFrame(list(left.items()), "doc_id bigint, text string")
    full = retrieval.bm25(now, "doc_id", "text", ["rare", "ab", "nowhere"]).orderBy(F.round("rank", 9), "doc_id").limit(40)
    assert near(index.search(["rare", "ab", "nowhere"], 40)) == near(full)
    assert {r.term: r.df for r in index.frequencies(["rare", "cd"]).collect()} == {"rare": 2, "cd": sum("cd" in t.split() for t in left.values())}
    assert index.search(["nowhere"], 5).count() == 0 and index.search([], 5).count() == 0
    assert TextIndex(spark, str(tmp_path / "none")).search(["ab"], 5).count() == 0


def test_ledger_replaces_only_what_changed(spark, tmp_path):
    tables, out = tmp_path / "tables", str(tmp_path / "out")
    names = "lineitem supplier nation part".split()
    frames = {n: spark.read.parquet(f"{DATA}/{n}.parquet") for n in names}
    for n in names:
        frames[n].write.parquet(f"{tables}/{n}.parquet")
    got = lambda: sorted(map(str, publish_ledger.read_ledger(spark, out).collect()))
    want = lambda: sorted(map(str, publish_ledger.ledger_rows(spark, str(tables)).collect()))
    places = publish_ledger.run(spark, str(tables), out)
    assert len(places) > 3 and got() == want()
    assert publish_ledger.run(spark, str(tables), out) == [] and got() == want()
    # one course leaves, alone in its institution; another gets more evidence
    homes = {r.s_suppkey: r.s_nationkey for r in frames["supplier"].collect()}
    alone = next(k for k, n in homes.items() if list(homes.values()).count(n) == 1)
    other = next(k for k in homes if homes[k] != homes[alone])
    kept = frames["lineitem"].where(f"l_suppkey <> {alone}")
    kept.unionAll(kept.where(f"l_suppkey = {other}").limit(5)).write.mode("overwrite").parquet(f"{tables}/lineitem.parquet")
    written = publish_ledger.run(spark, str(tables), out)
    gone = frames["nation"].where(f"n_nationkey = {homes[alone]}").first().n_name
    assert written and gone not in written and got() == want()
    assert gone not in {r.institution for r in publish_ledger.read_ledger(spark, out).collect()}


def on_disk(spark):
    """Bytes of each shuffle that Spark keeps, and the folders that have stored rows."""
    kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    sizes = Counter()
    for path in map(Path, kept):
        if path.name.startswith("shuffle_") and path.suffix == ".data" and path.exists():
            sizes[path.name.split("_")[1]] += path.stat().st_size
    return sizes, {p for p in Path(shared_folder(spark).removeprefix("file:")).glob("scratch-*") if any(p.rglob("part-*"))}


def test_ledger_lets_shuffles_and_stored_rows_go(spark, tmp_path, monkeypatch):
    sizes, had = on_disk(spark)
    stored, held = publish_ledger.stored, []

    def watched(df, **options):
        for _ in range(50):  # Spark deletes them a moment after it was let
            now, folders = on_disk(spark)
            now = sum(n for k, n in now.items() if k not in sizes)
            if now < MOST:
                break
            time.sleep(0.2)
        held.append((now, len(folders - had)))
        return stored(df, **options)

    monkeypatch.setattr(publish_ledger, "stored", watched)
    for _ in range(2):
        publish_ledger.run(spark, DATA, str(tmp_path / "out"))
        assert on_disk(spark)[1] == had
    # a shuffle of lines or pairs takes more
    assert max(n for n, _ in held) < MOST and max(n for _, n in held) <= 3, held


@pytest.mark.parametrize("n_statuses", [2, 70])
def test_ledger_of_odd_rows_equals_sql(spark, tmp_path, n_statuses):
    rng = random.Random(n_statuses)
    lines = [(rng.randint(1, 9) if k % 11 else None, rng.randint(1, 6), rng.randint(1, 5), float(rng.randint(1, 9)), f"é{k % n_statuses:02}", f"2024-01-{rng.randint(1, 28):02} 23:59:59") for k in range(400)]
    lines += [(7, 1, 1, 1.0, "F", "2024-02-01 00:00:00")] * 300 + [(k, 2, 2, 2.0, "O", "2024-03-01 00:00:00") for k in range(300)]  # a line and a pair that come often
    lines += [(1, None, 1, 1.0, "O", "2024-01-01 00:00:00"), (1, 1, None, 1.0, "O", "2024-01-01 00:00:00"), (1, 99, 1, 1.0, "O", "2024-01-01 00:00:00"), (1, 1, 98, 1.0, "O", "2024-01-01 00:00:00"), (1, 9, 1, 1.0, "F", None)]
    made = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_linestatus string, day string").withColumn("l_shipdate", F.col("day").cast("timestamp_ntz")).drop("day"),
        # a course in two institutions, one twice in the same, and one in none
        "supplier": spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "b", 2), (3, "c", 3), (3, "c2", 3), (4, "d", 2), (5, "e", None)], "s_suppkey bigint, s_name string, s_nationkey int"),
        "nation": spark.createDataFrame([(1, "N"), (2, "O"), (3, "P")], "n_nationkey int, n_name string"),
        "part": spark.createDataFrame([(1, "p", "k"), (2, "q", "k"), (3, "r", None), (3, "r2", "k"), (4, None, "k"), (5, "t", "k"), (9, "z", "k")], "p_partkey bigint, p_name string, p_type string"),
    }
    duck = duckdb.connect()
    for name, df in made.items():
        df.repartition(3).write.parquet(f"{tmp_path}/tables/{name}.parquet")
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/tables/{name}.parquet/*.parquet'")
    publish_ledger.run(spark, f"{tmp_path}/tables", f"{tmp_path}/out")
    got, want = publish_ledger.read_ledger(spark, f"{tmp_path}/out"), duck.sql(JOB2_SQL)
    assert table_of(got.columns, [tuple(r) for r in got.collect()]) == table_of(want.columns, want.fetchall())
    assert publish_ledger.run(spark, f"{tmp_path}/tables", f"{tmp_path}/out") == []


@pytest.mark.parametrize("name", ["job1_index_texts", "job2_publish_ledger"])
def test_registered_jobs_match_sql(name, same):
    same(name)
