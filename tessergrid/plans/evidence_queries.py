"""Text search, vectors, identities, classification and planning, bound to the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, isbn, markup, units
from ..functions import text as T
from ..functions import vectors as V
from ..operators import classify, knn, ranking
from ..registry import query
from ..session import Tables
from . import retrieval

QUERY_TERMS = "thre than erst ther".split()
_TOKENS = "regexp_extract_all(lower(text), '[a-z]+')"

# --- text search

_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("T1", f"SELECT doc_id, list_sort(list_distinct(list_filter({_TOKENS}, lambda w: w NOT IN ({_STOPS})))) AS terms FROM documents")
def search_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_sort(T.terms(F.col("text"), unicode=False)).alias("terms"))


_FORMS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.WORD_FORMS.items()) + "}"


@query("T2", f"SELECT s_suppkey, list_transform(regexp_extract_all(lower(x), '[a-z]+'), lambda w: coalesce(({_FORMS_SQL})[w], w)) AS forms FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Teaching robotics systems' WHEN 1 THEN 'Choose the calibrated sensors' ELSE s_name END AS x FROM supplier)")
def normal_forms(t: Tables) -> DataFrame:
    x = F.when(F.col("s_suppkey") % 3 == 0, "Teaching robotics systems").when(F.col("s_suppkey") % 3 == 1, "Choose the calibrated sensors").otherwise(F.col("s_name"))
    return t.supplier.select("s_suppkey", T.normal_forms(T.tokens(x, unicode=False)).alias("forms"))


_BM25 = f"""
tok AS (SELECT doc_id, {_TOKENS} AS w FROM documents), sizes AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM tok) WHERE term IN ('thre', 'than', 'erst', 'ther') GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT doc_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank FROM post JOIN df USING (term), sizes GROUP BY doc_id)"""


@query("T3 W6", f"WITH {_BM25} SELECT doc_id, round(rank, 6) AS rank FROM bm ORDER BY round(bm.rank, 9), doc_id LIMIT 20")
def bm25_topk(t: Tables) -> DataFrame:
    found = retrieval.bm25(t.documents, "doc_id", "text", QUERY_TERMS, unicode=False)
    return found.orderBy(F.round("rank", 9), "doc_id").limit(20).select("doc_id", F.round("rank", 6).alias("rank"))


@query("T4", f"""
WITH h AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents), w AS (SELECT * FROM h WHERE term IN ('thre', 'than', 'erst', 'ther')),
s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z]+')) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, ln(1 + any_value(n) / (1 + count(*))) AS w FROM w, n GROUP BY term)
SELECT w.doc_id, round(sum(df.w), 6) AS specificity, count(*) AS body_terms, count(s.term) AS title_terms FROM w JOIN df USING (term) LEFT JOIN s ON s.doc_id = w.doc_id AND s.term = w.term
GROUP BY w.doc_id ORDER BY round(sum(df.w), 6) DESC, count(*) DESC, count(s.term) DESC, w.doc_id LIMIT 30""")
def posting_search(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    found = retrieval.field_search(docs, "doc_id", {"body": "text", "title": "title"}, QUERY_TERMS, unicode=False)
    top = found.withColumn("specificity", F.round("specificity", 6)).orderBy(F.desc("specificity"), F.desc("body_terms"), F.desc("title_terms"), "doc_id").limit(30)
    return top.select("doc_id", "specificity", "body_terms", "title_terms")


@query("T5", "SELECT form, list_sort(list_distinct(list(word) || [form])) AS words FROM (VALUES " + ", ".join(f"('{f}', '{w}')" for w, f in T.WORD_FORMS.items() if f in ("robot", "analysis")) + ") v(form, word) GROUP BY form")
def expanded_query(t: Tables) -> DataFrame:
    forms = t.spark.createDataFrame([(w, f) for f in sorted(set(T.WORD_FORMS.values())) for w in T.words_of(f)], "word string, form string")
    wanted = t.spark.createDataFrame([("robot",), ("analysis",)], "form string")
    return forms.join(F.broadcast(wanted), "form").groupBy("form").agg(F.array_sort(F.collect_list("word")).alias("words"))


@query("T7", f"""
WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\\n+|[.!?;]\\s+')) AS passage FROM documents),
m AS (SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(passage), '[a-z]+')), ['thre', 'than', 'erst', 'ther'])) AS found FROM p)
SELECT doc_id, max(found)::INTEGER AS found, CASE WHEN max(found) = 4 THEN 'direct' ELSE 'partial' END AS support FROM m WHERE found >= 2 GROUP BY doc_id""")
def match_requirement(t: Tables) -> DataFrame:
    """The best passage per document: at least two of the wanted terms in one sentence."""
    wanted = F.array(*[F.lit(w) for w in QUERY_TERMS])
    passages = t.documents.select("doc_id", F.explode(F.split("text", r"\n+|[.!?;]\s+")).alias("passage"))
    found = passages.select("doc_id", F.size(F.array_intersect(T.tokens(F.col("passage"), unicode=False), wanted)).alias("found")).where("found >= 2")
    return found.groupBy("doc_id").agg(F.max("found").alias("found"), F.when(F.max("found") == 4, "direct").otherwise("partial").alias("support"))


# --- vectors


@query("T8", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def unit_vectors(t: Tables) -> DataFrame:
    v = V.doubles(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.unit(v)[0], 6).alias("first"))


_COS = "cos AS (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _query_vector(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 0").first()["embedding"]]


@query("T9 W5", f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM cos ORDER BY cos.score DESC, vec_id DESC LIMIT 20")
def cosine_topk(t: Tables) -> DataFrame:
    found = retrieval.cosine(t.embeddings, "vec_id", "embedding", _query_vector(t))
    return found.orderBy(F.desc("score"), F.desc("key")).limit(20).select(F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


_RRF = f"""
WITH {_BM25}, {_COS}, lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(rank, 9), doc_id) AS r FROM bm QUALIFY r <= 1000),
sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id DESC) AS r FROM cos QUALIFY r <= 1000)
SELECT id, round(sum(1.0 / (60 + r)), 8) AS rrf, list_sort(list(channel)) AS channels FROM (SELECT *, 'lexical' AS channel FROM lex UNION ALL SELECT *, 'semantic' FROM sem) GROUP BY id ORDER BY round(sum(1.0 / (60 + r)), 8) DESC, id LIMIT 10"""


@query("T10", _RRF)
def rrf_fusion(t: Tables) -> DataFrame:
    """Hybrid search: BM25 and cosine, each to 1,000 candidates, fused by reciprocal rank."""
    lexical = retrieval.bm25(t.documents, "doc_id", "text", QUERY_TERMS, unicode=False).withColumnRenamed("doc_id", "id")
    semantic = retrieval.cosine(t.embeddings, "vec_id", "embedding", _query_vector(t)).withColumnRenamed("key", "id")
    fused = retrieval.fuse(("lexical", lexical, [F.round("rank", 9), F.col("id")]), ("semantic", semantic, [F.desc("score"), F.desc("id")]))
    return fused.orderBy(F.round("rrf", 8).desc(), "id").limit(10).select("id", F.round("rrf", 8).alias("rrf"), "channels")


@query("T14 J19", """
WITH p AS (SELECT a.vec_id // 4 AS l, b.vec_id // 4 AS r, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id // 4 <> b.vec_id // 4 GROUP BY ALL HAVING s > 0)
SELECT l AS "left", r AS "right", round(s, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY l ORDER BY round(s, 9) DESC, r) <= 3""")
def knn_graph(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumn("parent", F.floor(F.col("vec_id") / 4))
    return knn.knn_graph(rows, "vec_id", "parent", "embedding", 3).select("left", "right", F.round("score", 6).alias("score"))


# --- units and views


@query("T12", "SELECT doc_id, length(text) AS n, sha256(text) AS sha FROM documents WHERE text <> ''")
def units_rebuild(t: Tables) -> DataFrame:
    cut = units.retrieval_units(t.documents, "doc_id", "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "unit_text"))), lambda x: x["unit_text"]), "")
    return cut.groupBy("doc_id").agg(F.sum(F.char_length("unit_text")).alias("n"), F.sha2(whole, 256).alias("sha"))


@query("S11", "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) <> '' AS has_h1 FROM pages")
def html_headings(t: Tables) -> DataFrame:
    made = t.pages.select("page_id", markup.html_structure(F.col("html")).alias("s"))
    return made.select("page_id", F.exists("s.headings", lambda h: h["level"] == 1).alias("has_h1"))


@query("S11")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", markup.html_structure(F.col("html")).alias("s")).select("page_id", "s.text", "s.headings", "s.images")


# --- identities and scalars

_ISBN_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN b || ((10 - s % 10) % 10)::VARCHAR ELSE '' END AS isbn FROM (
  SELECT o_orderkey, b, list_sum(list_transform(range(1, 13), lambda i: substr(b, i, 1)::INTEGER * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) AS s
  FROM (SELECT o_orderkey, '978' || lpad(o_orderkey::VARCHAR, 9, '0') AS b FROM orders))"""


@query("E1", _ISBN_SQL)
def isbn_check(t: Tables) -> DataFrame:
    """Thirteen digits, right for every third key and wrong by one for the others."""
    body = F.concat(F.lit("978"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    given = F.concat(F.substring(body, 1, 3), F.lit("-"), F.substring(body, 4, 9), F.lit(" "), ((isbn.check13(body) + F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1)) % 10).cast("string"))
    return t.orders.select("o_orderkey", isbn.canonical(given).alias("isbn"))


@query("E2 E3 E11", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN ['9780306406157', '9780131103627'] ELSE ['9780306406157'] END AS isbns, s_suppkey % 2 <> 0 AS single FROM supplier")
def isbn_extract(t: Tables) -> DataFrame:
    one, two = "Knuth. ISBN: 0-306-40615-2, p. 5; ISBN 978-0-306-40615-7", "; ISBN-10: 0131103628. ISBN 1234567890123"
    cited = F.when(F.col("s_suppkey") % 2 == 0, F.lit(one + two)).otherwise(F.lit(one))
    found = isbn.labelled(cited)
    return t.supplier.select("s_suppkey", found.alias("isbns"), (F.size(found) == 1).alias("single"))


@query("E4", """
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'title-author-edition' WHEN p_size < 20 THEN 'title-edition' ELSE 'title' END AS basis,
  CASE WHEN p_size < 10 THEN 'citation:' || lower(p_name) || '|' || lower(p_brand) || '|' || p_size WHEN p_size < 20 THEN 'title-edition:' || lower(p_name) || '|' || p_size ELSE 'title-candidate:' || lower(p_name) END AS key FROM part""")
def resource_identity(t: Tables) -> DataFrame:
    author, edition = F.when(F.col("p_size") < 10, F.col("p_brand")), F.when(F.col("p_size") < 20, F.col("p_size").cast("string"))
    return t.part.select("p_partkey", identity.resource_identity(F.lit(""), F.col("p_name"), author, edition).alias("r")).select("p_partkey", "r.basis", "r.key")


@query("E5", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'course-key:' || p_partkey ELSE lower(p_brand) || '|6.' || p_size END AS course FROM part")
def course_identity(t: Tables) -> DataFrame:
    code = F.when(F.col("p_size") % 4 == 0, F.lit("Unknown")).otherwise(F.concat(F.lit("MIT 6. "), F.col("p_size").cast("string"), F.lit(" / 18.1")))
    return t.part.select("p_partkey", identity.course_identity(F.col("p_brand"), code, F.col("p_partkey").cast("string")).alias("course"))


@query("E6 E24", "SELECT c_custkey, left(sha256(lower(c_name) || '|' || c_nationkey), 24) AS stable_id, sha256('{\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\"}') AS fingerprint FROM customer")
def stable_ids(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", identity.stable_id(identity.folded(F.col("c_name")), F.col("c_nationkey").cast("string")).alias("stable_id"), T.canonical_fingerprint(name=F.col("c_name"), key=F.col("c_custkey")).alias("fingerprint"))


@query("E15 E26", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_matches(url, '^https?://[A-Za-z0-9.-]+(:[0-9]+)?([/?#]|$)') AS public FROM pages")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), identity.public_url(F.col("url")).alias("public"))


@query("K1 E20", r"SELECT s_suppkey, CASE WHEN regexp_matches(trim(x), '^[=+\-@]') THEN '''' || x ELSE x END AS cell FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '=SUM(1)' WHEN 1 THEN ' @x' ELSE s_name END AS x FROM supplier)")
def formula_guard(t: Tables) -> DataFrame:
    x = F.when(F.col("s_suppkey") % 3 == 0, "=SUM(1)").when(F.col("s_suppkey") % 3 == 1, " @x").otherwise(F.col("s_name"))
    return t.supplier.select("s_suppkey", T.formula_safe(x).alias("cell"))


@query("E21 Q4", "SELECT doc_id, ceil(strlen(text) / 3)::BIGINT AS tokens, least(30, pow(2, doc_id % 8 - 1))::DOUBLE AS delay FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.ceil(F.octet_length("text") / 3).alias("tokens"), F.least(F.lit(30.0), F.pow(F.lit(2.0), (F.col("doc_id") % 8 - 1).cast("double"))).alias("delay"))


@query("E22", "SELECT event_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::DATE AS day FROM events")
def daily_bucket(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Los_Angeles")).alias("day"))


@query("E26", "SELECT o_custkey, max((year(o_orderdate), o_orderkey))[2] AS latest FROM orders GROUP BY o_custkey")
def latest_version(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max(F.struct(F.year("o_orderdate").alias("y"), "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("latest"))


_SECRET_SQL = ", ".join(f"regexp_matches(text, '{p}') AS {k}" for k, p in T.SECRET_PATTERNS.items() if "\"'" not in p)


# --- classification

TAXONOMY = {"metals": ["steel", "polished steel", "copper"], "alloys": ["brass", "bronze"], "soft": ["tin", "nickel"]}


def _hit_sql() -> str:
    rows = ", ".join(f"('{a}', '{p}', {len(p.split())})" for a, ps in TAXONOMY.items() for p in ps)
    return f"""h AS (SELECT p_partkey, area, max((tier, words)) AS b FROM (
      SELECT p_partkey, area, 4 AS tier, words FROM part, (VALUES {rows}) v(area, phrase, words) WHERE regexp_matches(lower(p_type), '\\b' || phrase || '\\b')
      UNION ALL SELECT p_partkey, area, 1, words FROM part, (VALUES {rows}) v(area, phrase, words) WHERE regexp_matches(lower(p_name), '\\b' || phrase || '\\b')) GROUP BY ALL)"""


@query("R1 R4 R15", f"WITH {_hit_sql()} SELECT p_partkey, area, b[1] AS tier, b[2] AS words FROM h WHERE NOT (area = 'soft' AND b[2] = 1 AND b[1] = 4 AND p_partkey IN (SELECT p_partkey FROM part WHERE regexp_matches(lower(p_type), 'plated')))")
def rule_classify(t: Tables) -> DataFrame:
    return classify.phrase_hits(t.part, "p_partkey", {"p_type": 4, "p_name": 1}, TAXONOMY, {"soft": ("plated", ["tin", "nickel"])})


@query("R9 R10 R12", "SELECT doc_id FROM documents WHERE 0.90 + (doc_id % 10) / 100.0 >= 0.95 AND doc_id % 4 <> 0")
def confidence_gate(t: Tables) -> DataFrame:
    p = F.create_map(F.lit("yes"), F.when(F.col("doc_id") % 4 == 0, 0.6).otherwise(0.97), F.lit("no"), F.lit(0.03))
    rows = t.documents.select("doc_id", F.round(0.90 + (F.col("doc_id") % 10) / 100.0, 2).alias("confidence"), p.alias("p"))
    return classify.gate(rows, "confidence", "p").select("doc_id")


@query("R16", "SELECT p_partkey, length(p_type)::INTEGER AS answer FROM part")
def state_inference(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_type", F.sha2("p_type", 256).alias("state"))
    answered = classify.fan_out(rows, "state", "p_partkey", lambda one: one.select("state", "p_partkey", F.length("p_type").alias("answer")))
    return answered.select("p_partkey", "answer")


@query("R16", """
WITH b AS (SELECT conv_id, turn, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 600 AS b, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS n FROM conversations),
c AS (SELECT *, coalesce(b <> lag(b) OVER w OR n <> lag(n) OVER w, false)::INT AS c FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS batch FROM c""")
def byte_batches(t: Tables) -> DataFrame:
    return classify.byte_batches(t.conversations, ["conv_id"], "turn", F.octet_length("text"), 600, 3).select("conv_id", "turn", "batch")


# --- planning


@query("P3", """
WITH r AS (SELECT c_nationkey, o_orderpriority AS req, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT o_custkey, turn, req FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY turn, req) = 1)
SELECT o_custkey, turn, req FROM f ORDER BY turn, req LIMIT 100""")
def round_robin(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("req"), "o_custkey", "o_totalprice", "o_orderkey")
    return ranking.interleave(rows, "req", F.col("req"), [F.desc("o_totalprice"), F.col("o_orderkey")], "o_custkey", 100).select("o_custkey", F.col("turn").cast("bigint").alias("turn"), "req")


@query("P4 P10", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS decision FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey")
def review_decisions(t: Tables) -> DataFrame:
    known = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(known, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("decision"))


@query("P7", "SELECT source, list_sort(list(doc_id) FILTER (WHERE contains(text, 'and the'))) AS variants FROM documents GROUP BY source")
def quote_lineage(t: Tables) -> DataFrame:
    hits = t.documents.where(F.col("text").contains("and the")).groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("variants"))
    return t.documents.select("source").distinct().join(hits, "source", "left")
