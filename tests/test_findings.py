"""Cases that reviews have found."""

import re
import time
from functools import reduce

import numpy as np
from pyspark.sql import functions as F


from jobs import publish_ledger
from tessergrid.functions import units
from tessergrid.functions.text import normal_forms, plain_text
from tessergrid.operators import aggregates, knn, ledger, matching, rules
from tessergrid.operators.evidence import hybrid, region_faults
from tessergrid.operators.identities import edition
from tessergrid.operators.text_index import TextIndex
from tessergrid.plans import ledger_queries, recall_queries, retrieval
from tessergrid.session import stored, tables
from tests.conftest import DATA


def test_discovery_places_every_course(spark):
    """More courses than a page: all have a place, each its own."""
    fields = spark.range(2500).selectExpr("concat('c', id) AS course_id", "'title' AS field", "CASE WHEN id % 2 = 0 THEN 'robot arms' ELSE 'robots and control' END AS text")
    rows = retrieval.discover(fields, "robot control").collect()
    assert sorted(r["place"] for r in rows) == list(range(1, 2501))
    order = sorted(rows, key=lambda r: (-r["specificity"], -r["source_terms"], -r["field_terms"], -r["phrase"], -r["title_terms"], r["course_id"]))
    assert [r["course_id"] for r in order] == [r["course_id"] for r in sorted(rows, key=lambda r: r["place"])]
    assert retrieval.discover(fields, "robot control", 10).count() == 10


def test_knn_of_uneven_groups(spark):
    """Groups of one, of four and of hundreds of vectors, ties and opposite vectors, against all pairs; blocks do not matter."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(900, 3)), 1) + 0.05
    v[100:110] = v[0:10]
    grp = [0 if i < 400 else i if i < 500 else i // 4 for i in range(900)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    names, at = np.unique(grp, return_inverse=True)
    best = np.full((len(names), len(names)), -1.0)
    np.maximum.at(best, (at[:, None].repeat(900, 1), at[None, :].repeat(900, 0)), u @ u.T)
    want = set()
    for i, row in enumerate(best):
        near = [(-round(float(s), 9), int(names[j])) for j, s in enumerate(row) if j != i and s > 0]
        want |= {(int(names[i]), right, -s) for s, right in sorted(near)[:3]}
    rows = spark.createDataFrame([(i, grp[i], v[i].tolist()) for i in range(900)], "k bigint, g bigint, v array<double>")
    for blocks in (1, 4):
        got = {(r.left, r.right, round(r.score, 9) + 0.0) for r in knn.knn_graph(rows, "k", "g", "v", 3, blocks=blocks).collect()}
        assert {x[:2] for x in got} == {x[:2] for x in want} and len(got) == len(want)


def test_knn_keeps_up(spark):
    """12,000 vectors: sorting every row's scores took minutes of a task."""
    rows = spark.range(12000).select("id", F.floor(F.col("id") / 4).alias("g"), F.array(*[F.randn(i) for i in range(16)]).alias("v"))
    began = time.perf_counter()
    assert knn.knn_graph(rows, "id", "g", "v").count() == 9000
    assert time.perf_counter() - began < 30


def shuffled(spark, run):
    """Bytes of shuffle that a function's stages write."""
    sc = spark.sparkContext

    def total():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    wait = spark._jsc.sc().listenerBus().waitUntilEmpty
    wait()
    before = total()
    run()
    wait()
    return total() - before


def test_index_moves_finished_blocks(spark, tmp_path):
    """Occurrences are counted in their rows: 2.4 bytes go through shuffles for a byte of text (before: 6.3)."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    index = TextIndex(spark, f"file://{tmp_path}/index", unicode=False)
    moved = shuffled(spark, lambda: index.add(docs, 0))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert moved < 4 * size


def test_index_counts_in_awkward_texts(spark, tmp_path):
    rows = [(-257, "b a b"), (-1, ""), (0, None), (255, "a"), (256, "a a a"), (256, "a"), (None, "z"), (10**12, "é É e_1")]
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame(rows, "doc_id bigint, text string"), 0)
    got = {tuple(r) for r in index.postings().collect()}
    assert got == {("b", -257, 2, 3), ("a", -257, 1, 3), ("a", 255, 1, 1), ("a", 256, 3, 3), ("é", 10**12, 2, 3), ("e_1", 10**12, 1, 3)}
    heads = {(r.term, r.block): (r.n, r.max_tf, r.min_dl) for r in index.table("postings").collect()}
    assert heads[("a", 0)] == (1, 1, 1) and heads[("a", 1)] == (1, 3, 3) and heads[("b", -2)] == (1, 2, 3)
    assert index.totals() == (6, 10 / 6)


def test_stored_rows_are_files(spark):
    """What is stored is compressed Parquet, of which columns are read; what Parquet cannot hold is a checkpoint."""
    one = stored(spark.range(10).withColumn("v", F.lit("x" * 100)))
    assert one.inputFiles() and one.count() == 10 and one.schema["v"].dataType.typeName() == "string"
    assert stored(spark.sql("SELECT 1 AS a, 2 AS a")).count() == 1 and stored(spark.sql("SELECT NULL AS n")).count() == 1
    assert stored(spark.range(0)).count() == 0


def test_edition_is_worked_out_once(spark):
    """One pass over a text, not one for every ordinal: the plan spells its words once."""
    rows = spark.createDataFrame([("Second Ed. ",), (None,), ("",), ("twelfth",), ("thirteenth ed",), ("3rd edition",)], "said string").repartition(2)
    made = rows.select("said", edition(F.col("said")).alias("e"))
    assert {(r.said, r.e) for r in made.collect()} == {("Second Ed. ", "2"), (None, ""), ("", ""), ("twelfth", "12"), ("thirteenth ed", "thirteenth"), ("3rd edition", "3")}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_units_leave_in_small_batches(spark):
    """A batch of long texts is handed on piece by piece, with the same units."""
    text = "Ein Satz mit Ümlaut. " * 20000
    made = units.retrieval_units(spark.createDataFrame([(i, text) for i in range(6)] + [(6, None), (7, "")], "doc_id bigint, text string").coalesce(1), "doc_id", "text")
    rows = made.where("doc_id = 5").orderBy("unit").collect()
    assert [(r.start, r.end) for r in rows] == units.spans(text) and "".join(r.unit_text for r in rows) == text
    assert all(r.before == text[max(0, r.start - 256) : r.start] and r.after == text[r.end : r.end + 256] for r in rows)
    assert made.select("doc_id").distinct().count() == 6
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()


def test_region_faults_move_digests(spark):
    """Texts of regions stay where they are; the verdicts are those of the texts."""
    cut = lambda rows: spark.createDataFrame(rows, "doc_id bigint, region int, region_text string, before string, after string")
    pad = "x" * 50
    then = [(i, r, f"{i}-{r}-{pad}", "ab", "c") for i in range(300) for r in range(8)]
    now = [(i, r, t + ("!" if (i, r) == (7, 1) else ""), "a" if (i, r) == (7, 2) else b, "bc" if (i, r) == (7, 2) else a) for i, r, t, b, a in then if (i, r) != (7, 3)]
    same = spark.createDataFrame([(i, "-", "+" if i == 8 else "-") for i in range(299)], "doc_id bigint, was string, now string")
    faults = region_faults(cut(then), cut(now), same)
    got = {(r.doc_id, r.region): r.fault for r in faults.where("fault is not null").collect()}
    assert got == {(7, 1): "text-differs", (7, 2): "context-differs", (7, 3): "offsets"} | {(8, r): "source-changed" for r in range(8)} | {(299, r): "unknown-source" for r in range(8)}
    plan = faults._jdf.queryExecution().optimizedPlan().toString()
    assert "region_text" not in plan.split("Join")[1].splitlines()[0] and "sha2" in plan


def test_passages_are_cut_once(spark):
    """Matches, labels and context come from one cut of the texts, and forms are looked up for few words."""
    fields = spark.createDataFrame([("a", "title", "Robots and control"), ("a", "description", "Design robots. Nothing here."), ("b", "title", "None of it")], "course_id string, field string, text string")
    made = matching.match_requirements(fields, ["robotics control"], context="robot expert")
    assert [(r.course_id, r.matched_terms) for r in made.collect()] == [("a", ["control", "robot"])]
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    words = spark.createDataFrame([(["robots", "learn", "x", "analyse"],)], "w array<string>").select(normal_forms(F.col("w")).alias("w"))
    assert words.first().w == ["robot", "learn", "x", "analysis"] and "INSET" in words._jdf.queryExecution().optimizedPlan().toString().upper()


def test_recurrence_repeats_no_rows(spark):
    """Owners of several identities, nulls and repeats are counted as distinct counts do, without a copy of every row for each of them."""
    rows = [(i % 7 if i % 5 else None, i % 4 if i % 6 else None, i % 3 if i % 9 else None) for i in range(400)] + [(9, None, None), (9, 1, 1), (8, 2, None), (8, 3, None)]
    got = aggregates.recurrence(spark.createDataFrame(rows, "item int, own int, n int"), "item", "own", "n", least=0)
    want = {(k, len(m), len({o for o, _ in m} - {None}), len({d for _, d in m} - {None})) for k in {r[0] for r in rows} for m in [[r[1:] for r in rows if r[0] == k]]}
    assert {tuple(r)[:4] for r in got.collect()} == want
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_ledger_fingerprint_adds_whole_numbers(spark):
    """Any order of the rows has one fingerprint, any other value another; digests are not read back as decimal text."""
    row = F.struct(F.lit("i").alias("institution"), *[F.col("id").cast(k).alias(n) for n, k in (f.strip().split(" ") for f in publish_ledger._LEDGER.split(",")) if n not in ("statuses", "institution", "first_seen", "last_seen")], F.lit(None).cast("date").alias("first_seen"), F.current_date().alias("last_seen"), F.array(F.lit("F")).alias("statuses"))
    rows = spark.range(50).select(row.alias("r")).select("r.*").select(*publish_ledger.COLUMNS)
    told = lambda df: publish_ledger._summary(df).first()
    assert told(rows) == told(rows.orderBy(F.desc("course_id")).repartition(3)) and told(rows)["n_rows"] == 50
    others = [rows.where("course_id > 0"), rows.withColumn("course", F.when(F.col("course_id") != 7, F.col("course"))), rows.withColumn("n_orders", F.col("n_orders") + (F.col("course_id") == 3).cast("bigint"))]
    assert len({told(df)["fingerprint"] for df in [rows, *others]}) == 4
    assert "conv(" not in publish_ledger._summary(rows)._jdf.queryExecution().executedPlan().toString()


def test_recall_leaves_nodes_where_they_are(spark):
    """At most two channels of candidates go to the nodes; no node's words are shuffled."""
    nodes = spark.range(20).selectExpr("concat('r', id) AS id", "'region' AS kind", "concat('r', id) AS parent", "array('robot') AS words", "cast(null AS string) AS review_state", "false AS stale")
    scores = nodes.selectExpr("id", "cast(length(id) AS double) AS score")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = hybrid(nodes, scores.withColumnRenamed("score", "rank"), scores, ["robot"], 3)
        assert got.count() == 3 and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_evidence_is_gathered_before_areas(spark):
    """Repeated fields, terms and places give one row each, and no task holds the rows of all areas to make them distinct."""
    fields = spark.createDataFrame([("a", "course_title_or_subject_code", "title", "Robot arms, robot ARMS")] * 3 + [("a", "course_title_or_subject_code", "title", "robot arms"), ("a", "official_school", "school", "robot arms"), ("b", None, "title", "robot arms")], "course_key string, basis string, field string, text string")
    terms = spark.createDataFrame([(f"area{i % 5}", phrase, True) for i in range(10) for phrase in ("robot arms", "Robot  Arms", "arms")] + [("area0", None, True), (None, "arms", True)], "area string, phrase string, topic boolean")
    got = rules.phrase_evidence(fields, terms)
    want = [("a", area, "course_title_or_subject_code", 3, "title", p, n) for p, n in (("robot arms", 2), ("arms", 1)) for area in [f"area{i}" for i in range(5)] + [None] * (n == 1)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")]


def test_views_of_regions_move_texts_alone(spark):
    """Links and neighbours are worked out on digests: less goes through shuffles than the texts three times (before: eight times)."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = tables(spark, DATA)
        texts = shuffled(spark, lambda: t.documents.repartition(4, "doc_id").write.format("noop").mode("overwrite").save())
        moved = shuffled(spark, lambda: recall_queries.read_region(t).write.format("noop").mode("overwrite").save())
        assert moved < 3 * texts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_ledger_rules_look_once(spark):
    """Wordings are one pattern, tried once a row; ISBNs and bare titles are worked out once; names without markup are only lower-cased."""
    assert all(a.startswith("^") for p in ledger.NO_RESOURCE for a in (p, *p.split("$|")))
    texts = ["", " ", " A  b", "a\tB", "x <b>y</b>", "Q&amp;A", "&nbsp;z", "a b", "Ünder  \n x", None, "Plain Name", "a&b", "1 < 2", "&AMP;lt;"]
    full = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", reduce(lambda s, e: s.replace(*e), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")), re.sub(r"<[^>]*>", " ", x)).lower()).strip(" ")
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", plain_text(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in got} == {x: None if x is None else full(x) for x in texts}
    made = ledger_queries.material_identities(tables(spark, DATA))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("no required textbooks?") == 2  # once for each of the two inputs
