"""Filters, joins, aggregations and rankings of the catalogue, bound to the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import aggregates, filters, incremental, joins, ranking, trees
from ..registry import query
from ..session import Tables


# --- filters and projections


@query("F1 F3", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_type), 'brass')")
def multi_filter(t: Tables) -> DataFrame:
    return filters.contains_all(t.part, {"p_name": "A", "p_type": "brass", "p_brand": None}).select("p_partkey", "p_name", "p_type")


@query("F2", "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS total FROM supplier WHERE s_acctbal > 0 ORDER BY s_name, s_suppkey LIMIT 20 OFFSET 3")
def browse_page(t: Tables) -> DataFrame:
    rows = t.supplier.where("s_acctbal > 0")
    return filters.page(rows, [F.col("s_name"), F.col("s_suppkey")], 3, 20).select("s_suppkey", "s_name", "total")


_WORDS_SQL = "regexp_extract_all(lower(text), '[a-z]+')"


@query("F4 T6", f"SELECT doc_id FROM documents WHERE NOT contains(' ' || array_to_string({_WORDS_SQL}, ' ') || ' ', ' of the ') AND lang IN ('en', 'de')")
def exclude_phrase(t: Tables) -> DataFrame:
    words = T.tokens(F.col("text"), unicode=False)
    return t.documents.where(F.col("lang").isin("en", "de")).where(~T.contains_phrase(words, ["of", "the"])).select("doc_id")


@query("T6", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_WORDS_SQL}, ' ') || ' ', ' and the ')")
def phrase_filter(t: Tables) -> DataFrame:
    return t.documents.where(T.contains_phrase(T.tokens(F.col("text"), unicode=False), ["and", "the"])).select("doc_id")


@query("F5", "SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT' OR o_orderstatus = 'P') AS flagged FROM orders GROUP BY o_custkey")
def nested_flag(t: Tables) -> DataFrame:
    nested = t.orders.groupBy("o_custkey").agg(F.collect_set(F.struct("o_orderpriority", "o_orderstatus")).alias("rows"))
    return nested.select("o_custkey", F.exists("rows", lambda r: (r["o_orderpriority"] == "1-URGENT") | (r["o_orderstatus"] == "P")).alias("flagged"))


@query("F9", "SELECT o_custkey, list_sort(list(o_orderkey) FILTER (WHERE o_totalprice > 100000)) AS big FROM orders GROUP BY o_custkey")
def compact_projection(t: Tables) -> DataFrame:
    nested = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("rows"))
    kept = F.array_sort(F.transform(F.filter("rows", lambda r: r["o_totalprice"] > 100000), lambda r: r["o_orderkey"]))
    return nested.select("o_custkey", F.when(F.size(kept) > 0, kept).alias("big"))


@query("F10", "SELECT doc_id, CASE WHEN lang = 'en' THEN left(text, 20) END AS original, CASE WHEN lang <> 'en' THEN n_chars END AS size FROM documents")
def conditional_view(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.col("lang") == "en", F.left("text", F.lit(20))).alias("original"), F.when(F.col("lang") != "en", F.col("n_chars")).alias("size"))


@query("F11 J20", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)")
def active_guard(t: Tables) -> DataFrame:
    return filters.active(t.documents.select("doc_id"), t.labels.where("quality = 0"), "doc_id")


@query("F12", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT IN (1, 7, 42)")
def json_path_filter(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.where(k.isin(1, 7, 42)).select("event_id", k.alias("k"))


@query("F13", """
SELECT p_partkey, field, text FROM (
  SELECT p_partkey, 'p_name' AS field, p_name AS text FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part
) WHERE trim(text) <> ''""")
def grounded_fields(t: Tables) -> DataFrame:
    return filters.unpivot(t.part, "p_partkey", ["p_name", "p_brand", "p_type"])


@query("F14", "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS search_text FROM part")
def search_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("search_text"))


@query("F15", """
SELECT s_suppkey AS id, 'supplier' AS field, s_name AS text FROM supplier
UNION ALL SELECT DISTINCT l_suppkey, 'part_name', p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5""")
def candidate_fields(t: Tables) -> DataFrame:
    own = filters.unpivot(t.supplier.withColumnRenamed("s_name", "supplier"), "s_suppkey", ["supplier"]).withColumnRenamed("s_suppkey", "id")
    titles = t.lineitem.join(t.part.where("p_size < 5"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), F.lit("part_name").alias("field"), F.col("p_name").alias("text")).distinct()
    return own.unionByName(titles)


@query("F16", "SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority) || list(o_orderstatus))) AS labels FROM orders GROUP BY o_custkey")
def distinct_labels(t: Tables) -> DataFrame:
    both = F.array_distinct(F.flatten(F.array(F.collect_set("o_orderpriority"), F.collect_set("o_orderstatus"))))
    return t.orders.groupBy("o_custkey").agg(F.array_sort(both).alias("labels"))


# --- joins


@query("J1", "SELECT c_custkey, c_name, r.n_nationkey FROM customer c JOIN nation r ON c.c_nationkey = r.n_nationkey JOIN (SELECT DISTINCT c_custkey AS k FROM customer) x ON x.k = c.c_custkey")
def strict_one_to_one_join(t: Tables) -> DataFrame:
    inventory = t.customer.select("c_custkey", "c_name")
    classified = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey")
    return joins.strict_one_to_one(inventory, classified, "c_custkey")


@query("J2", "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_enrich(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


@query("J3", """
SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side
FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def coverage_mismatch(t: Tables) -> DataFrame:
    return joins.mismatches(t.orders, t.customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


@query("J4", f"SELECT DISTINCT doc_id, source FROM (SELECT doc_id, source, unnest({_WORDS_SQL}) AS w FROM documents) WHERE w = 'thre'")
def postings_nodes(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text"), unicode=False))).alias("w")).where("w = 'thre'")
    return found.join(t.documents.select("doc_id", "source"), "doc_id").select("doc_id", "source")


@query("J5", "SELECT vec_id FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE e.label = d.doc_id % 10")
def fresh_vectors(t: Tables) -> DataFrame:
    nodes = t.documents.select("doc_id", (F.col("doc_id") % 10).cast("int").alias("fingerprint"))
    return t.embeddings.join(nodes, (F.col("vec_id") == F.col("doc_id")) & (F.col("label") == F.col("fingerprint"))).select("vec_id")


@query("J6", "SELECT user_id, event_id AS current_event FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def scope_pointer(t: Tables) -> DataFrame:
    pointer = t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("p")).select("user_id", F.col("p.event_id").alias("current_event"))
    return t.events.select("event_id").join(pointer, F.col("event_id") == F.col("current_event")).select("user_id", "current_event")


_EDGES_SQL = """(SELECT 'c' || c_custkey AS src, 'in' AS relation, 'n' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'part-of', 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'in', 'n' || s_nationkey FROM supplier)"""


def _edges(t: Tables) -> DataFrame:
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = t.customer.select(node("c", "c_custkey").alias("src"), F.lit("in").alias("relation"), node("n", "c_nationkey").alias("dst"))
    b = t.nation.select(node("n", "n_nationkey").alias("src"), F.lit("part-of").alias("relation"), node("r", "n_regionkey").alias("dst"))
    c = t.supplier.select(node("s", "s_suppkey").alias("src"), F.lit("in").alias("relation"), node("n", "s_nationkey").alias("dst"))
    return a.unionByName(b).unionByName(c)


@query("J7", f"SELECT src, relation, dst FROM {_EDGES_SQL} WHERE src = 'n7' OR dst = 'n7'")
def neighbors(t: Tables) -> DataFrame:
    return joins.neighbours(_edges(t), "n7")


@query("J8", f"SELECT e.src, e.dst, n.n_name FROM {_EDGES_SQL} e JOIN nation n ON e.dst = 'n' || n.n_nationkey WHERE e.src = 'c1' AND relation = 'in'")
def outgoing_lookup(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"), "n_name")
    return _edges(t).where("src = 'c1' and relation = 'in'").join(nodes, "dst").select("src", "dst", "n_name")


@query("J9", "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderpriority) IN (SELECT c_custkey, '1-URGENT' FROM customer WHERE c_acctbal < 0)")
def requested_semi(t: Tables) -> DataFrame:
    asked = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    return t.orders.join(asked, ["o_custkey", "o_orderpriority"], "left_semi").select("o_orderkey", "o_custkey")


@query("J11", """
SELECT p.p_partkey, CASE WHEN n = 1 THEN k END AS resolved, n > 1 AS ambiguous FROM part p
LEFT JOIN (SELECT p_name AS nm, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY p_name) r ON p.p_name = r.nm""")
def ambiguity_lookup(t: Tables) -> DataFrame:
    known = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.count("*").alias("n"))
    return t.part.select("p_partkey", "p_name").join(known, "p_name", "left").select("p_partkey", F.when(F.col("n") == 1, F.col("k")).alias("resolved"), (F.col("n") > 1).alias("ambiguous"))


@query("J12", """
SELECT c_custkey, coalesce('nation:' || n_nationkey, 'external:' || left(sha256(lower(c_mktsegment)), 24)) AS entity_id
FROM customer LEFT JOIN nation ON n_nationkey < 5 AND lower(n_name) = lower(c_mktsegment)""")
def alias_resolution(t: Tables) -> DataFrame:
    aliases = t.nation.where("n_nationkey < 5").select(F.lower("n_name").alias("normal"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("entity_id"))
    return joins.resolve_alias(t.customer, aliases, "c_mktsegment").select("c_custkey", "entity_id")


@query("J13", "SELECT o_custkey, min(o_orderpriority) AS subject FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 1")
def single_subject_join(t: Tables) -> DataFrame:
    subjects = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s")).where(F.size("s") == 1)
    return subjects.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", F.col("s")[0].alias("subject"))


_BANDS_SQL = "(SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS low, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + o_orderkey % 60 AS high FROM orders)"


@query("J14", f"""
SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other_o_orderkey FROM {_BANDS_SQL} a JOIN {_BANDS_SQL} b
ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.low <= b.high AND b.low <= a.high AND (a.low <> b.low OR a.high <> b.high)""")
def interval_overlap(t: Tables) -> DataFrame:
    low = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    bands = t.orders.select("o_custkey", "o_orderkey", low.alias("low"), (low + F.col("o_orderkey") % 60).alias("high"))
    return joins.overlapping(bands, ["o_custkey"], "o_orderkey", "low", "high", 60).select("o_custkey", "o_orderkey", "other_o_orderkey")


_NEEDS = [("r1", "steel"), ("r2", "brass"), ("r3", "tin")]


@query("J15", f"SELECT req, p_partkey FROM part, (VALUES {', '.join(map(str, _NEEDS))}) r(req, word) WHERE contains(lower(p_type), word)")
def requirement_cross(t: Tables) -> DataFrame:
    # a handful of requirements as an array in the row: no join at all
    needs = F.array(*[F.struct(F.lit(r).alias("req"), F.lit(w).alias("word")) for r, w in _NEEDS])
    met = F.filter(needs, lambda n: F.contains(F.lower("p_type"), n["word"]))
    return t.part.select("p_partkey", F.explode(met).alias("n")).select(F.col("n.req").alias("req"), "p_partkey")


@query("J16", "SELECT a.conv_id, a.turn, b.turn AS near FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND abs(a.turn - b.turn) <= 2")
def band_neighbors(t: Tables) -> DataFrame:
    return joins.band_pairs(t.conversations, ["conv_id"], "turn", 2, ["role"]).select("conv_id", "turn", "near")


@query("J17", "SELECT doc_id, p AS point, (p // 1000)::BIGINT AS region FROM (SELECT doc_id, n_chars, unnest([0, 999, 1000, 2500]) AS p FROM documents) WHERE p < n_chars")
def point_in_interval(t: Tables) -> DataFrame:
    points = t.documents.select("doc_id", F.explode(F.array(*[F.lit(x) for x in (0, 999, 1000, 2500)])).alias("point"))
    cut = t.documents.where("n_chars > 0").select("doc_id", "n_chars", F.posexplode(F.sequence(F.lit(0), F.col("n_chars") - 1, F.lit(1000))).alias("region", "start"))
    cut = cut.select("doc_id", F.col("region").cast("bigint").alias("region"), "start", F.least(F.col("start") + 1000, F.col("n_chars")).alias("end"))
    return joins.locate(points, cut, "doc_id", "point", "start", "end", 1000).select("doc_id", "point", "region")


@query("J18", "SELECT p_partkey, l_orderkey AS course FROM part JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) ON p_partkey = l_partkey WHERE p_size = 7")
def exploded_membership(t: Tables) -> DataFrame:
    books = t.lineitem.groupBy("l_partkey").agg(F.collect_set("l_orderkey").alias("courses"))
    return t.part.where("p_size = 7").join(books, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", F.explode("courses").alias("course"))


@query("J20", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


# --- aggregations


@query("A1 A12", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def status_histogram(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("A11", "SELECT facet, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS facet FROM part) GROUP BY facet")
def facet_counts(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.array_distinct(F.split("p_type", " "))).alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))


@query("A2 A6", """
SELECT l_partkey, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_owners, count(DISTINCT o_custkey % 7) AS n_identities,
  CASE WHEN count(DISTINCT o_custkey % 7) > 1 THEN 'cross-identity' ELSE 'same-identity' END AS scope
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey HAVING count(DISTINCT o_custkey) >= 2""")
def recurrence_cross_group(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "o_custkey", (F.col("o_custkey") % 7).alias("identity"))
    return aggregates.recurrence(rows, "l_partkey", "o_custkey", "identity")


@query("A3", """
SELECT sha256(regexp_replace(trim(lower(text)), '[ \t\r\n]+', ' ', 'g')) AS key, arg_min(lang, doc_id) AS lang, list_sort(list(DISTINCT source)) AS source, bool_or(n_chars > 2000) AS needs_review, count(*) AS n_sources
FROM documents GROUP BY 1""")
def multi_source_merge(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("key", F.sha2(F.regexp_replace(F.trim(F.lower("text")), r"[ \t\r\n]+", " "), 256))
    return aggregates.merge_sources(rows, ["key"], "doc_id", ["lang"], ["source"], {"needs_review": F.col("n_chars") > 2000})


@query("A5", """
WITH link AS (SELECT l_suppkey AS course, l_partkey AS book, count(DISTINCT l_returnflag) AS sources, count(*) AS n FROM lineitem GROUP BY ALL),
book AS (SELECT book, count(*) AS courses FROM link GROUP BY book)
SELECT (SELECT sum(n)::BIGINT FROM link) AS records, (SELECT count(*) FROM link) AS links, (SELECT count(*) FROM book) AS books,
  (SELECT count(DISTINCT course) FROM link) AS courses, (SELECT count(*) FROM book WHERE courses > 1) AS cross_course, (SELECT count(*) FROM link WHERE sources > 1) AS same_course_multi""")
def book_metrics(t: Tables) -> DataFrame:
    link = t.lineitem.groupBy(F.col("l_suppkey").alias("course"), F.col("l_partkey").alias("book")).agg(F.count_distinct("l_returnflag").alias("sources"), F.count("*").alias("n"))
    book = link.groupBy("book").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.count_if(F.col("sources") > 1).alias("m"))
    courses = link.agg(F.count_distinct("course").alias("courses"))
    totals = book.agg(F.sum("n").alias("records"), F.sum("c").alias("links"), F.count("*").alias("books"), F.count_if(F.col("c") > 1).alias("cross_course"), F.sum("m").alias("same_course_multi"))
    return totals.join(F.broadcast(courses)).select("records", "links", "books", "courses", "cross_course", "same_course_multi")


@query("A7", """
SELECT n_name, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def ledger_manifest(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"))


@query("A8", """
SELECT r_name, n_name, count(*) AS customers, count(*) FILTER (WHERE c_acctbal > 0) AS solvent
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY ROLLUP (r_name, n_name)""")
def hierarchical_counts(t: Tables) -> DataFrame:
    rows = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") > 0).alias("solvent"))


@query("A10", """
SELECT p_name, arg_max(p_brand, (p_size > 25, -p_partkey)) AS p_brand, -max((p_size > 25, -p_partkey))[2] AS p_partkey, bool_and(p_retailprice > 1000) AS all_verified, count(*) AS n_variants
FROM part GROUP BY p_name""")
def consolidate_books(t: Tables) -> DataFrame:
    return aggregates.consolidate(t.part, "p_name", ["p_brand"], F.col("p_size") > 25, "p_partkey", F.col("p_retailprice") > 1000)


@query("A13", """
SELECT req, CASE WHEN bool_or(p_size > 40) THEN 'candidate-match' WHEN count(p_partkey) > 0 THEN 'partial-candidate-match' ELSE 'uncovered' END AS status, count(p_partkey) AS links
FROM (VALUES ('r1', 'steel'), ('r2', 'brass'), ('r3', 'tin'), ('r4', 'paper')) r(req, word) LEFT JOIN part ON contains(lower(p_type), word) GROUP BY req""")
def requirement_coverage(t: Tables) -> DataFrame:
    spark = t.spark
    needs = spark.createDataFrame([*_NEEDS, ("r4", "paper")], "req string, word string")
    words = F.array(*[F.lit(w) for _, w in [*_NEEDS, ("r4", "paper")]])
    links = t.part.select("p_size", "p_partkey", F.explode(F.filter(words, lambda w: F.contains(F.lower("p_type"), w))).alias("word"))
    counted = links.groupBy("word").agg(F.bool_or(F.col("p_size") > 40).alias("direct"), F.count("*").alias("links"))
    status = F.when(F.col("direct"), "candidate-match").when(F.col("links") > 0, "partial-candidate-match").otherwise("uncovered")
    return needs.join(counted, "word", "left").select("req", status.alias("status"), F.coalesce("links", F.lit(0)).alias("links"))


@query("A14", """
SELECT p_brand, CASE max(CASE WHEN p_size > 40 THEN 2 WHEN p_size > 20 THEN 1 ELSE 0 END) WHEN 2 THEN 'must-have' WHEN 1 THEN 'review-needed' ELSE 'supplemental' END AS priority, count(*) AS assignments
FROM part GROUP BY p_brand""")
def acquisition_plan(t: Tables) -> DataFrame:
    rank = F.when(F.col("p_size") > 40, 2).when(F.col("p_size") > 20, 1).otherwise(0)
    names = F.array(F.lit("supplemental"), F.lit("review-needed"), F.lit("must-have"))
    return t.part.groupBy("p_brand").agg(F.get(names, F.max(rank)).alias("priority"), F.count("*").alias("assignments"))


@query("A15", """
WITH e AS (SELECT doc_id, 'q' || quality AS label FROM labels), p AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 'q1' ELSE 'q0' END AS label FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
b AS (SELECT coalesce(e.label, p.label) AS label, (e.doc_id IS NOT NULL)::INT AS e, (p.doc_id IS NOT NULL)::INT AS p FROM e FULL JOIN p ON e.doc_id = p.doc_id AND e.label = p.label),
c AS (SELECT label, count(*) FILTER (WHERE e = 1 AND p = 1) AS tp, count(*) FILTER (WHERE e = 0) AS fp, count(*) FILTER (WHERE p = 0) AS fn FROM b GROUP BY ROLLUP (label))
SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM c""")
def label_eval(t: Tables) -> DataFrame:
    expected = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"))
    predicted = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.when(F.col("n_chars") > 1500, "q1").otherwise("q0").alias("label"))
    return aggregates.evaluate_labels(expected, predicted, "doc_id", "label").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("A16", """
WITH m AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, pos),
n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label)
SELECT m.label, pos::INTEGER AS pos, round(m / norm, 6) AS value FROM m JOIN n ON m.label = n.label""")
def mean_pool(t: Tables) -> DataFrame:
    return aggregates.mean_pool(t.embeddings, "label", "embedding").withColumn("value", F.round("value", 6))


@query("A17 A20", "SELECT event_type AS phase, CASE WHEN value > 50 THEN 'complete' ELSE 'pending' END AS state, count(*) AS n FROM events GROUP BY ALL")
def state_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("phase"), F.when(F.col("value") > 50, "complete").otherwise("pending").alias("state")).agg(F.count("*").alias("n"))


@query("A19", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def usage_summary(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("A21", "SELECT source, count(*) AS n, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def ordered_fingerprint(t: Tables) -> DataFrame:
    return aggregates.ordered_fingerprint(t.documents, "source", "doc_id", F.col("text"))


# --- rankings and sequences


@query("W1", """
SELECT c_nationkey, c_custkey, rank, CASE WHEN rank = 1 AND c_acctbal > 5000 THEN 'must-have' ELSE 'supplemental' END AS tier FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment <> 'BUILDING'), (c_mktsegment = 'MACHINERY'), -coalesce(urgent, 0), -coalesce(orders, 0), -coalesce(spent, 0), c_acctbal < 0, c_mktsegment <> 'AUTOMOBILE', -c_acctbal, coalesce(orders, 0) = 0, c_custkey) AS rank
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
) WHERE rank <= 3""")
def per_requirement_topk(t: Tables) -> DataFrame:
    stats = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rows = t.customer.join(stats, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["orders", "urgent", "spent"])
    segment = F.col("c_mktsegment")
    order = [segment != "BUILDING", segment == "MACHINERY", -F.col("urgent"), -F.col("orders"), -F.col("spent"), F.col("c_acctbal") < 0, segment != "AUTOMOBILE", -F.col("c_acctbal"), F.col("orders") == 0, F.col("c_custkey")]
    top = ranking.top_per(rows, ["c_nationkey"], order, 3)
    return top.select("c_nationkey", "c_custkey", F.col("rank").cast("bigint").alias("rank"), F.when((F.col("rank") == 1) & (F.col("c_acctbal") > 5000), "must-have").otherwise("supplemental").alias("tier"))


@query("W2", """
WITH g AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE p_size IS NOT NULL) OVER w AS banded FROM part WINDOW w AS (PARTITION BY p_brand, p_type)),
o AS (SELECT DISTINCT a.p_brand, a.p_type FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size <> b.p_size AND abs(a.p_size - b.p_size) <= 2)
SELECT g.p_partkey, row_number() OVER (PARTITION BY g.p_brand, g.p_type ORDER BY CASE WHEN n >= 2 AND n = banded AND o.p_brand IS NULL THEN p_size END, g.p_partkey) AS place FROM g LEFT JOIN o ON g.p_brand = o.p_brand AND g.p_type = o.p_type""")
def rerank_bands(t: Tables) -> DataFrame:
    """Equal-fit groups are put in band order only where every band is known and no two different ones overlap."""
    group = Window.partitionBy("p_brand", "p_type")
    rows = t.part.select("p_partkey", "p_brand", "p_type", "p_size")
    # bands [size - 1, size + 1]: of the sorted sizes only neighbours need comparing
    size_order = group.orderBy("p_size")
    gap = F.col("p_size") - F.lag("p_size").over(size_order)
    overlap = rows.withColumn("bad", (gap > 0) & (gap <= 2))
    judged = overlap.withColumns({"n": F.count("*").over(group), "banded": F.count("p_size").over(group), "any_bad": F.coalesce(F.bool_or("bad").over(group), F.lit(False))})
    key = F.when((F.col("n") >= 2) & (F.col("n") == F.col("banded")) & ~F.col("any_bad"), F.col("p_size"))
    return judged.select("p_partkey", F.row_number().over(group.orderBy(key.asc_nulls_last(), "p_partkey")).cast("bigint").alias("place"))


@query("W3", "SELECT c_custkey, list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'P')) AS strengths FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def annotate_strength(t: Tables) -> DataFrame:
    found = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("strengths"))
    return t.customer.select("c_custkey").join(found, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "strengths")


@query("W4", f"""
WITH o AS (SELECT doc_id, unnest({_WORDS_SQL}) AS w, unnest(range(len({_WORDS_SQL}))) AS p FROM documents),
l AS (SELECT doc_id, p, max(CASE WHEN w = 'thre' THEN p END) OVER x AS a, max(CASE WHEN w = 'erst' THEN p END) OVER x AS b FROM o WHERE w IN ('thre', 'erst') WINDOW x AS (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING))
SELECT doc_id, min(p - least(a, b))::BIGINT AS span FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id""")
def min_span(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.posexplode(T.tokens(F.col("text"), unicode=False)).alias("position", "term"))
    return ranking.min_span(words, "doc_id", "position", "term", ["thre", "erst"]).select("doc_id", F.col("span").cast("bigint").alias("span"))


@query("W5", "SELECT event_id, value FROM events ORDER BY value DESC, event_id DESC LIMIT 25")
def heap_topk(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("value"), F.desc("event_id")).limit(25).select("event_id", "value")


@query("W7", "SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(p_type), p_type) AS place FROM part GROUP BY p_type")
def group_ordering(t: Tables) -> DataFrame:
    counted = t.part.groupBy("p_type").agg(F.count("*").alias("n"))
    return ranking.numbered(counted, [F.desc("n"), F.lower("p_type"), F.col("p_type")]).withColumn("place", F.col("place").cast("bigint"))


@query("W8", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def best_per_region(t: Tables) -> DataFrame:
    best = t.events.groupBy("user_id").agg(F.max(F.struct("value", (-F.col("event_id")).alias("e"))).alias("b"))
    return best.select("user_id", (-F.col("b.e")).alias("event_id"), "b.value")


@query("W9", """
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('seed7|' || doc_id), doc_id) AS round FROM documents),
s AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY lang, source) AS turn FROM (SELECT DISTINCT lang, source FROM documents))
SELECT doc_id, round FROM r JOIN s USING (lang, source) ORDER BY round, turn, lang, source LIMIT 60""")
def stratified_sample(t: Tables) -> DataFrame:
    return ranking.stratified_sample(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "seed7", 60, "lang").select("doc_id", F.col("round").cast("bigint").alias("round"))


@query("W10", "SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1000) AS section_end FROM conversations")
def nav_ranges(t: Tables) -> DataFrame:
    return ranking.section_ends(t.conversations.withColumn("last", F.lit(1000).cast("bigint")), "conv_id", "turn", "turn", "last").select("conv_id", "turn", "section_end")


@query("W11", """
WITH h AS (SELECT *, 1 + (turn * 7 + conv_id) % 4 AS level FROM conversations)
SELECT a.conv_id, a.turn, max(b.turn) AS parent FROM h a LEFT JOIN h b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.level < a.level GROUP BY a.conv_id, a.turn""")
def outline_tree(t: Tables) -> DataFrame:
    headings = t.conversations.select("conv_id", "turn", (1 + (F.col("turn") * 7 + F.col("conv_id")) % 4).alias("level"))
    return trees.parents(headings, "conv_id", "turn", "level").select("conv_id", "turn", "parent")


_DEEP = "SELECT *, 1 + (len(text) * 31 + turn * 7) % 50 AS level FROM conversations WHERE text IS NOT NULL"


@query("W11 T17 M10", f"""
WITH h AS ({_DEEP})
SELECT a.conv_id, a.turn, a.level, max(b.turn) FILTER (WHERE b.turn < a.turn AND b.level < a.level) AS parent, min(b.turn) FILTER (WHERE b.turn > a.turn AND b.level <= a.level) AS ends
FROM h a JOIN h b ON a.conv_id = b.conv_id GROUP BY ALL""")
def deep_sections(t: Tables) -> DataFrame:
    """Parents and sections of an outline of 50 levels."""
    rows = t.conversations.where("text is not null").select("conv_id", "turn", (1 + (F.char_length("text") * 31 + F.col("turn") * 7) % 50).alias("level"))
    return trees.sections(rows, "conv_id", "turn", "level")


@query("W12", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def next_links(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_turn"))


@query("W13", """
SELECT conv_id, turn, spent::BIGINT AS spent FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations)
WHERE position <= 5 AND spent <= 1200""")
def budget_prefix(t: Tables) -> DataFrame:
    return ranking.within_budget(t.conversations, ["conv_id"], [F.col("turn")], F.char_length("text"), 1200, 5).select("conv_id", "turn", "spent")


@query("W15", "SELECT event_id, count(*) OVER w AS calls, round(sum(value) OVER w, 4) AS load FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)")
def rolling_60s(t: Tables) -> DataFrame:
    rolled = ranking.rolling(t.events, "event_type", "ts", 60, calls=F.count("*"), load=F.sum("value"))
    return rolled.select("event_id", "calls", F.round("load", 4).alias("load"))


# --- mutation and incremental maintenance


@query("M1 T15", """
SELECT doc_id, CASE WHEN a.f IS NULL THEN 'insert' WHEN b.f IS NULL THEN 'delete' WHEN a.f = b.f THEN 'same' ELSE 'update' END AS change
FROM (SELECT doc_id, sha256(text) AS f FROM documents WHERE doc_id % 10 <> 1) a
FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS f FROM documents WHERE doc_id % 10 <> 2) b USING (doc_id)""")
def incremental_upsert(t: Tables) -> DataFrame:
    old = t.documents.where("doc_id % 10 <> 1").select("doc_id", F.sha2("text", 256).alias("f"))
    new = t.documents.where("doc_id % 10 <> 2").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("f"))
    return incremental.snapshot_diff(old, new, "doc_id", "f")


@query("M2", f"SELECT sha256(src || '|' || relation || '|' || dst) AS id, count(*) AS n FROM (SELECT * FROM {_EDGES_SQL} UNION ALL SELECT * FROM {_EDGES_SQL} WHERE relation = 'in') GROUP BY 1")
def edge_dedupe(t: Tables) -> DataFrame:
    edges = _edges(t)
    every = edges.unionByName(edges.where("relation = 'in'"))
    return every.groupBy(F.sha2(F.concat_ws("|", "src", "relation", "dst"), 256).alias("id")).agg(F.count("*").alias("n"))


@query("M4 P4", "SELECT user_id, event_id, row_number() OVER w AS version, CASE WHEN lead(event_id) OVER w IS NULL THEN 'current' ELSE 'stale' END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def review_history(t: Tables) -> DataFrame:
    return incremental.history(t.events.select("user_id", "event_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", F.col("version").cast("bigint").alias("version"), "state")


@query("M7", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def legacy_dedupe(t: Tables) -> DataFrame:
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("M8", f"""
WITH RECURSIVE e AS (SELECT dst AS parent, src AS child FROM {_EDGES_SQL}), c AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT child, depth + 1 FROM c JOIN e ON e.parent = c.node)
SELECT node, depth FROM c""")
def closure(t: Tables) -> DataFrame:
    edges = _edges(t).select(F.col("dst").alias("parent"), F.col("src").alias("child"))
    return incremental.closure(edges, t.spark.createDataFrame([("r1",)], "node string"))


@query("M11", """
SELECT p_partkey, rule FROM (SELECT p_partkey, CASE WHEN NOT coalesce(p_size < 45, false) THEN 'size' END AS a, CASE WHEN NOT coalesce(p_retailprice > 950, false) THEN 'price' END AS b FROM part)
UNPIVOT (rule FOR n IN (a, b))""".replace("SELECT p_partkey, rule FROM (", "SELECT p_partkey, rule FROM ("))
def rule_violations(t: Tables) -> DataFrame:
    return filters.violations(t.part, "p_partkey", {"size": F.col("p_size") < 45, "price": F.col("p_retailprice") > 950})


@query("M11", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(t: Tables) -> DataFrame:
    return incremental.cascade(t.orders, t.customer.where("c_acctbal < 0"), ("o_custkey", "c_custkey")).select("o_orderkey")
