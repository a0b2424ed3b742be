import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessergrid.functions import identity, isbn, markup, units, vectors
from tessergrid.functions import text as T
from tessergrid.operators import aggregates, classify, evidence, filters, incremental, joins, knn, ranking
from tessergrid.plans import brief, retrieval
from tessergrid.streaming import jobs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!é漢😀", max_size=120), st.integers(8, 40))
def test_units_rebuild_the_text(text, most):
    cut = units.spans(text, most)
    assert "".join(text[a:b] for a, b in cut) == text
    assert all(b > a and len(text[a:b].encode()) <= most for a, b in cut)


def test_isbn(spark):
    rows = spark.createDataFrame([("0-306-40615-2",), ("0306406153",), ("9780306406157",), ("9780306406158",), ("080442957X",), ("",), (None,), ("12X4567890",)], "v string")
    assert [r.x for r in rows.select(isbn.canonical(F.col("v")).alias("x")).collect()] == ["9780306406157", "", "9780306406157", "", "9780804429573", "", "", ""]


def test_text_functions(spark):
    assert one(spark, T.tokens(F.col("t")), t="Çá_1 — Straße b-c") == ["çá_1", "straße", "b", "c"]
    assert one(spark, T.plain_text(F.col("t")), t=" <b>A &amp; B</b>\n C ") == "a & b c"
    assert [one(spark, T.formula_safe(F.col("t")), t=t) for t in ("=1", " @x", "a=1", "-3")] == ["'=1", "' @x", "a=1", "'-3"]
    assert one(spark, T.contains_phrase(F.split("t", " "), ["b", "c"]), t="a b c") is True
    assert one(spark, T.contains_phrase(F.split("t", " "), []), t="a") is False
    assert [one(spark, T.flag(F.col("t")), t=t) for t in (" TRUE", "0", "maybe")] == [True, False, None]
    assert one(spark, identity.folded(F.col("t")), t="ﬁ  Straße") == "fi strasse"
    assert one(spark, identity.edition_number(F.col("t")), t="Second ed.") == "2"
    assert one(spark, identity.surnames(F.col("t")), t="Rob Pike and Knuth, Donald; Pike, R.") == ["knuth", "pike"]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [3.0, 4.0])], "k int, v array<double>")
    got = {r.key: r.score for r in retrieval.cosine(rows, "k", "v", [6.0, 8.0]).collect()}
    assert got.keys() == {1, 4} and math.isclose(got[1], 1)
    with pytest.raises(ValueError):
        retrieval.cosine(rows, "k", "v", [0.0, 0.0])
    assert [r.u for r in rows.select(vectors.unit(F.col("v")).alias("u")).collect()][0] == [0.6, 0.8]


def test_strict_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    with pytest.raises(ValueError, match="unmatched"):
        joins.strict_one_to_one(a, b, "k")
    with pytest.raises(ValueError, match="repeated"):
        joins.strict_one_to_one(a.union(a), a, "k")
    assert {(r.k, r.side) for r in joins.mismatches(a, b, "k").collect()} == {(2, "left"), (3, "right")}


def test_pages_and_rules(spark):
    rows = spark.range(10)
    assert [(r.id, r.total) for r in filters.page(rows, [F.desc("id")], 2, 3).collect()] == [(7, 10), (6, 10), (5, 10)]
    with pytest.raises(ValueError):
        filters.page(rows, [F.col("id")], 0, 101)
    assert {(r.id, r.rule) for r in filters.violations(rows, "id", {"low": F.col("id") < 9, "set": F.lit(None).cast("boolean") | (F.col("id") > 0)}).collect()} == {(9, "low"), (0, "set")}


def test_closure_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    got = {(r.node, r.depth) for r in incremental.closure(edges, spark.createDataFrame([("a",)], "n string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_closure_of_a_deep_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(67)], "parent string, child string").coalesce(1)
    got = {(r.node, r.depth) for r in incremental.closure(edges, spark.createDataFrame([("n0",)], "n string")).collect()}
    assert got == {(f"n{i}", i) for i in range(68)}


def test_edits_anywhere_are_stale(spark):
    was = spark.createDataFrame([(1, "x" * 150), (2, "y" * 195 + "end" + "y" * 40), (3, ""), (4, "gone"), (5, "z" * 120)], "doc_id int, text string")
    now = spark.createDataFrame([(1, "x" * 150), (2, "y" * 195 + "END" + "y" * 40), (3, ""), (5, "z" * 90)], "doc_id int, text string")
    cut = lambda df: units.regions(df, "doc_id", "text", 100, 20)
    hashes = was.select("doc_id", F.lit("-").alias("was")).join(now.select("doc_id", F.lit("-").alias("now")), "doc_id", "left")
    faults = {(r.doc_id, r.region): r.fault for r in evidence.region_faults(cut(was), cut(now), hashes).collect()}
    assert faults == {(1, 0): None, (1, 1): None, (2, 0): None, (2, 1): "text-differs", (2, 2): "context-differs", (4, 0): "unknown-source", (5, 0): "text-differs", (5, 1): "offsets"}
    whole = was.select("doc_id", F.sha2("text", 256).alias("was")).join(now.select("doc_id", F.sha2("text", 256).alias("now")), "doc_id", "left")
    assert {r.doc_id for r in evidence.region_faults(cut(was), cut(now), whole).where("fault = 'source-changed'").collect()} == {2, 5}


def test_upsert_and_history(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert {(r.k, r.v) for r in incremental.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c")}
    done = spark.createDataFrame([(1, "a")], "k int, v string")
    assert [r.k for r in incremental.pending(old, done, "k", "v").collect()] == [2]


def test_knn_blocks_agree(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(60, 5))
    rows = spark.createDataFrame([(i, i // 2, [float(x) for x in v[i]]) for i in range(60)] + [(60, 99, [0.0] * 5)], "k bigint, g bigint, v array<double>")
    a, b = ({(r.left, r.right) for r in knn.knn_graph(rows, "k", "g", "v", 2, blocks=n).collect()} for n in (1, 5))
    assert a == b and len(a) == 60


def test_label_evaluation_without_support(spark):
    e, p = spark.createDataFrame([(1, "a")], "k int, l string"), spark.createDataFrame([(1, "b")], "k int, l string")
    got = {r.l: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in aggregates.evaluate_labels(e, p, "k", "l").collect()}
    assert got == {"a": (0, 0, 1, None, 0.0), "b": (0, 1, 0, 0.0, None), None: (0, 1, 1, 0.0, 0.0)}


def test_rank_operators(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 3, 1)], "g string, k int, v int")
    assert {(r.g, r.k) for r in ranking.top_per(rows, ["g"], [F.desc("v"), F.col("k")], 1).collect()} == {("a", 1), ("b", 3)}
    assert [r.k for r in ranking.interleave(rows, "g", F.col("g"), [F.col("k")], "k", 3).collect()] == [1, 3, 2]
    spans = spark.createDataFrame([(1, p, t) for p, t in enumerate("x a x b a x c".split())], "d int, p int, t string")
    assert [(r.d, r.span) for r in ranking.min_span(spans, "d", "p", "t", ["a", "b", "c"]).collect()] == [(1, 3)]


def test_classification(spark):
    rows = spark.createDataFrame([(1, "Steel work"), (2, "stainless steelwork"), (3, "brass and steel")], "k int, t string")
    hits = classify.phrase_hits(rows, "k", {"t": 2}, {"s": ["steel"], "b": ["brass"]})
    assert {(r.k, r.area) for r in hits.collect()} == {(1, "s"), (3, "s"), (3, "b")}
    assert {(r.k, r.primary) for r in classify.primary(hits, "k").collect()} == {(1, "s"), (3, "other")}


def test_markup(spark):
    html = "<h1>A <i>b</i></h1><p>x<img src='i.png' alt='fig'>y</p><script>no</script><h2>C</h2>"
    got = spark.createDataFrame([(html,), (None,)], "h string").select(markup.html_structure(F.col("h")).alias("s")).collect()
    assert [(h.level, h.title) for h in got[0].s.headings] == [(1, "A b"), (2, "C")]
    image = got[0].s.images[0]
    assert got[0].s.text[image.offset :].startswith("fig") and "no" not in got[0].s.text and got[1].s.text == ""


def test_job_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1, "pending"), (1, 5, 2, "running"), (2, 3, 3, "pending"), (1, 4, 4, "late")], "job bigint, at bigint, tie bigint, state string")
    rows.write.parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = jobs.job_state_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {(r.job, r.state) for r in spark.table("job_states").collect()} == {(1, "running"), (2, "pending")}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_windows_as_stream(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:10", 1.0), ("2024-01-01 00:00:50", 2.0), ("2024-01-01 00:05:00", 3.0)], "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = jobs.windowed(source, "ts", [], "1 minute", None, "v", late="1 minute").writeStream.outputMode("complete").format("memory").queryName("minutes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("minutes").collect()) == [1, 2]
    lease = events.withColumns({"state": F.lit("running"), "lease_until": F.col("ts")})
    assert {r.state for r in jobs.expire_leases(lease, "2024-01-01 00:01:00").collect()} == {"running", "review-needed"}


def test_brief():
    got = brief.extract_intent("Must calibrate robot sensors, optional machine vision, not drones; already knows linear algebra. Compare archives within MIT", {"MIT": "mit"})
    assert [(c["description"], c["priority"]) for c in got["capabilities"]] == [("calibrate robot sensors", "essential"), ("machine vision", "supplemental"), ("Compare archives", "essential")]
    assert got["exclude"] == ["drones"] and got["existing_knowledge"] == ["linear algebra"] and got["institutions"] == ["mit"]
    brief.validate_brief(got, 3)
    lists = brief.extract_intent("Optional welding, without painting, wall papering and must have loads; use only Yale and MIT. Optional loads", {"MIT": "mit", "Yale": "yale"})
    assert [(c["description"], c["priority"]) for c in lists["capabilities"]] == [("welding", "supplemental"), ("loads", "essential")]
    assert lists["exclude"] == ["painting", "wall papering"] and lists["institutions"] == ["mit", "yale"] and lists["constraints"] == ["use only Yale and MIT"]
    assert brief.extract_intent("Read 6.003 notes.\n\n")["capabilities"][0]["description"] == "Read 6.003 notes"
    for wrong, n in (({}, 3), (got, 0), (got, True), (got | {"exclude": [""]}, 3)):
        with pytest.raises(ValueError):
            brief.validate_brief(wrong, n)


def test_bounded_answers():
    rows = [{"id": i, "text": "é" * 3000} for i in range(4)]
    kept, out = brief.bounded(rows, 3000)
    assert out == 0 and len(kept) == 4 and all(len(r["text"]) <= 750 for r in kept)
    kept, out = brief.bounded(rows, 900)
    assert len(kept) + out == 4 and out > 0 and rows[0]["text"] == "é" * 3000


def test_numbered_over_ranges(spark):
    rows = [(i * 37 % 101, f"r{i}") for i in range(101)]
    got = {r.v: r.place for r in ranking.numbered(spark.createDataFrame(rows, "k int, v string").repartition(5), [F.col("k").desc()]).collect()}
    assert got == {v: 101 - k for k, v in rows}
    assert ranking.numbered(spark.createDataFrame([], "k int"), [F.col("k")]).count() == 0


def test_knn_does_not_depend_on_blocks(spark):
    import random

    rng = random.Random(1)
    df = spark.createDataFrame([(i, i // 2, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(90, 90, [0.0] * 4), (91, 91, [1.0, 2.0])], "id int, grp int, v array<double>")
    runs = [sorted((r.left, r.right, round(r.score, 9)) for r in knn.knn_graph(df, "id", "grp", "v", 3, blocks=b).collect()) for b in (1, 4)]
    assert runs[0] == runs[1] and len(runs[0]) > 50
