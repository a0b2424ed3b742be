"""Hybrid recall, excerpts, units and staleness, on documents; tests run them on awkward nodes too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import units
from ..operators import evidence as E
from ..registry import query
from ..session import Tables
from . import fixtures as X
from . import retrieval
from .bound import Bound, Digested, Words

WANTED = Words(("thre", "than", "erst"), ("drift", "robots", "sensors"))

# Documents are regions of 25 sources; a third has two units, a seventh knowledge about it, every tenth has changed since.
NODES = Bound(X.NODES, """
    SELECT concat('r', CAST(doc_id AS STRING)) AS id, 'region' AS kind, concat('r', CAST(doc_id AS STRING)) AS parent, concat('s', CAST(doc_id % 25 AS STRING)) AS source_id, CAST(floor(doc_id / 25) AS INT) AS region_index, text, CAST(NULL AS STRING) AS review_state,
      md5(text) AS fingerprint, CASE WHEN doc_id % 10 = 3 THEN 'old' ELSE md5(text) END AS stored, element_at(embedding, 1) AS x, element_at(embedding, 2) AS y FROM {documents} LEFT JOIN {embeddings} ON vec_id = doc_id
    UNION ALL SELECT concat('u', CAST(doc_id AS STRING), 'a'), 'retrieval-unit', concat('r', CAST(doc_id AS STRING)), concat('s', CAST(doc_id % 25 AS STRING)), NULL, substr(text, 1, 200), NULL,
      md5(text), md5(text), element_at(embedding, 3), element_at(embedding, 4) FROM {documents} JOIN {embeddings} ON vec_id = doc_id WHERE doc_id % 3 = 0
    UNION ALL SELECT concat('u', CAST(doc_id AS STRING), 'b'), 'retrieval-unit', concat('r', CAST(doc_id AS STRING)), concat('s', CAST(doc_id % 25 AS STRING)), NULL, substr(text, 201, 200), NULL,
      md5(text), md5(text), element_at(embedding, 3), element_at(embedding, 5) FROM {documents} JOIN {embeddings} ON vec_id = doc_id WHERE doc_id % 3 = 0
    UNION ALL SELECT concat('k', CAST(doc_id AS STRING)), 'knowledge', concat('r', CAST(doc_id AS STRING)), concat('s', CAST(doc_id % 25 AS STRING)), NULL, substr(text, 50, 100), CASE WHEN doc_id % 2 = 0 THEN 'reviewed' ELSE 'draft' END,
      md5(text), md5(text), element_at(embedding, 6), element_at(embedding, 7) FROM {documents} JOIN {embeddings} ON vec_id = doc_id WHERE doc_id % 7 = 0""")  # fmt: skip
LINKS = Bound(X.LINKS, """
    SELECT concat('r', CAST(a.doc_id AS STRING)) AS src, concat('r', CAST(b.doc_id AS STRING)) AS dst, (a.doc_id * 31 % 97) / 100.0 AS cosine, CASE WHEN a.doc_id % 9 = 0 THEN 'stale' ELSE md5(a.text) END AS src_fp, md5(b.text) AS dst_fp
    FROM {documents} a JOIN {documents} b ON b.doc_id = a.doc_id + 1 + a.doc_id % 5
    UNION ALL SELECT concat('r', CAST(a.doc_id AS STRING)), concat('r', CAST(b.doc_id AS STRING)), (b.doc_id * 17 % 89) / 100.0, md5(a.text), CASE WHEN b.doc_id % 8 = 0 THEN 'stale' ELSE md5(b.text) END FROM {documents} a JOIN {documents} b ON b.doc_id = a.doc_id - a.doc_id % 7""")  # fmt: skip
HEADINGS = Bound(X.HEADINGS, """
    SELECT CAST(conv_id AS STRING) AS source_id, turn + 1 AS ord, length(text) % 7 + 1 AS level, split_part(text, '.', 1) AS title, CAST(floor(turn / 3) AS INT) + 1 AS page FROM {conversations}""")  # fmt: skip
PAGE_COUNTS = Bound(X.PAGE_COUNTS, "SELECT CAST(conv_id AS STRING) AS source_id, CAST(floor(max(turn) / 3) AS INT) + 2 AS pages FROM {conversations} GROUP BY conv_id")
CLAIMS = Bound(X.CLAIMS, """
    SELECT concat('c', CAST(doc_id AS STRING)) AS claim, CASE WHEN doc_id % 11 = 0 THEN 'zz' ELSE concat('r', CAST(doc_id AS STRING)) END AS region_id,
      CASE doc_id % 6 WHEN 0 THEN upper(substr(text, 20, 40)) WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE substr(text, 20, 40) END AS quote FROM {documents}""")  # fmt: skip
_SENSE = [1.0, 0.2]

_RECALL = f"""
{NODES.sql}, tok AS (SELECT id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM nodes), sizes AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, unnest(w) AS term, len(w) AS dl FROM tok) WHERE term IN ({WANTED.sql}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank FROM post JOIN df USING (term), sizes GROUP BY id),
sem AS (SELECT id, (x * 1.0 + y * 0.2) / sqrt(x * x + y * y) / sqrt(1.04) AS score FROM nodes WHERE x * x + y * y > 0),
chan AS (SELECT * FROM (SELECT 'lexical' AS c, id, row_number() OVER (ORDER BY round(rank, 9), id) AS r FROM bm UNION ALL SELECT 'semantic', id, row_number() OVER (ORDER BY round(score, 9) DESC, id DESC) FROM sem) WHERE r <= {E.CHANNEL}),
firsts AS (SELECT c, parent, id, kind, r FROM chan JOIN nodes USING (id) WHERE kind <> 'knowledge' OR review_state = 'reviewed' QUALIFY row_number() OVER (PARTITION BY c, parent ORDER BY r) = 1),
places AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY r) AS place FROM firsts),
fused AS (SELECT parent, round(sum(1.0 / (60 + place)), 12) AS score, max(place) FILTER (WHERE c = 'lexical') AS lexical_place, max(place) FILTER (WHERE c = 'semantic') AS semantic_place,
  coalesce(max(id) FILTER (WHERE c = 'semantic' AND kind = 'retrieval-unit'), max(id) FILTER (WHERE c = 'lexical'), max(id) FILTER (WHERE c = 'semantic')) AS node_id FROM places GROUP BY parent),
told AS (SELECT f.*, n.fingerprint <> n.stored AS stale FROM fused f JOIN nodes n ON n.id = node_id WHERE semantic_place IS NOT NULL OR n.kind = 'knowledge' OR regexp_matches(lower(n.text), '\\b({WANTED.pattern})\\b')),
ordered AS (SELECT *, row_number() OVER w AS position, sum(CASE WHEN stale THEN 0 ELSE 1 END) OVER w AS good FROM told WINDOW w AS (ORDER BY coalesce(semantic_place <> 1, true), score DESC, parent)),
recalled AS (SELECT position::INTEGER AS position, parent, node_id, score, lexical_place::INTEGER AS lexical_place, semantic_place::INTEGER AS semantic_place, CASE WHEN stale THEN 'gap' ELSE 'result' END AS outcome
  FROM ordered WHERE good < 6 OR good = 6 AND NOT stale)"""


def _recalled(t: Tables) -> DataFrame:
    nodes = NODES.frame(t).withColumns({"words": T.tokens(F.col("text"), unicode=False), "stale": F.col("fingerprint") != F.col("stored")})
    lexical = retrieval.bm25(nodes, "id", "text", WANTED.of(t), unicode=False).select(F.col("doc_id").alias("id"), F.round("rank", 9).alias("rank"))
    vectors = nodes.where("x is not null").select("id", F.array("x", "y").alias("v"))
    semantic = retrieval.cosine(vectors, "id", "v", _SENSE).select(F.col("key").alias("id"), F.round("score", 9).alias("score"))
    return E.hybrid(nodes, lexical, semantic, WANTED.of(t), 6)


@query("T10", f"WITH {_RECALL} SELECT * FROM recalled")
def hybrid_recall(t: Tables) -> DataFrame:
    return _recalled(t)


# where each wanted word stands, found by trying every place
_HITS = """
hits AS (SELECT doc_id, p, w FROM (SELECT doc_id, text, unnest(['thre', 'than', 'erst', 'ther']) AS w, unnest([len(text), len(text), len(text), len(text)]) AS n FROM documents) d,
  LATERAL (SELECT unnest(list_filter(range(1, n + 1), lambda i: lower(substr(text, i, 4)) = w)) AS p) WHERE NOT regexp_matches(substr(text, p + 4, 1), '[\\pL\\pN_]') AND (p = 1 OR NOT regexp_matches(substr(text, p - 1, 1), '[\\pL\\pN_]')))"""


@query("T11", f"""
WITH {_HITS}, best AS (
  SELECT a.doc_id, a.p, count(DISTINCT b.w) AS n FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.p < a.p + 400 GROUP BY a.doc_id, a.p
  QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY count(DISTINCT b.w) DESC, a.p) = 1
), s AS (SELECT d.doc_id, text, greatest(0, least(coalesce(p - 1, 0) - 100, length(text) - 400)) AS start FROM documents d LEFT JOIN best USING (doc_id))
SELECT doc_id, start::INTEGER AS start, least(length(text), start + 400)::INTEGER AS "end", substr(text, start + 1, 400) AS excerpt FROM s""")
def excerpt_window(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", "text", units.excerpt(F.col("text"), ["thre", "than", "erst", "ther"], 400).alias("x"))
    return cut.select("doc_id", "x.start", "x.end", F.substring("text", F.col("x.start") + 1, F.lit(400)).alias("excerpt"))


# one unit a step: the whole characters of at most 4,000 bytes, then back to the last boundary of the second half
_UNITS = r"""
u AS (
  SELECT doc_id, 0 AS unit, 0::BIGINT AS start, ''::VARCHAR AS unit_text, text AS rest, text FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, unit + 1, start + length(unit_text), unit_next, substr(rest, length(unit_next) + 1), text FROM (
    SELECT *, CASE WHEN length(part) < length(rest) AND length(cut) >= length(part) // 2 AND cut <> '' THEN cut ELSE part END AS unit_next FROM (
      SELECT *, regexp_extract(part, '(?s)^(.*(?:\n|[.!?]\s+))', 1) AS cut FROM (
        SELECT *, decode(unhex(left(hx, 2 * b))) AS part FROM (
          SELECT *, CASE WHEN length(hx) <= 8000 THEN length(hx) // 2 WHEN hx[8001] NOT IN ('8', '9', 'A', 'B') THEN 4000 WHEN hx[7999] NOT IN ('8', '9', 'A', 'B') THEN 3999 WHEN hx[7997] NOT IN ('8', '9', 'A', 'B') THEN 3998 ELSE 3997 END AS b FROM (
            SELECT *, hex(encode(left(rest, 4001))) AS hx FROM u WHERE rest <> '')))))
)"""


@query("T12 T13", f"""
WITH RECURSIVE {_UNITS} SELECT doc_id, (unit - 1)::INTEGER AS unit, start::INTEGER AS start, (start + length(unit_text))::INTEGER AS "end", unit_text,
  CASE WHEN start = 0 THEN '' ELSE substr(text, greatest(start - 256, 0) + 1, least(start, 256)) END AS before, substr(text, start + length(unit_text) + 1, 256) AS after
FROM u WHERE unit > 0""")
def utf8_units(t: Tables) -> DataFrame:
    return units.retrieval_units(t.documents.where("text <> ''"), "doc_id", "text")


_STALE_FROM = """
was AS (SELECT doc_id, r AS region, substr(text, r * 1500 + 1, 1500) AS region_text, right(left(text, r * 1500), least(r * 1500, 200)) AS before, substr(text, (r + 1) * 1500 + 1, 200) AS after, sha256(text) AS hash
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1499) // 1500)) AS r FROM documents))"""


@query("S10", """
SELECT doc_id, r::INTEGER AS region, (r * 6000)::BIGINT AS start, substr(text, r * 6000 + 1, 6000) AS region_text,
  CASE WHEN r = 0 THEN '' ELSE substr(text, r * 6000 - 599, 600) END AS before, substr(text, (r + 1) * 6000 + 1, 600) AS after
FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 5999) // 6000)) AS r FROM documents)""")
def chunk_regions(t: Tables) -> DataFrame:
    return units.regions(t.documents, "doc_id", "text").withColumn("start", F.col("start").cast("bigint"))


@query("T18", """
WITH now AS (SELECT doc_id, CASE WHEN lang = 'de' THEN replace(text, ' und ', ' oder ') ELSE text END AS text FROM documents WHERE lang <> 'fr'),
r AS (SELECT d.doc_id, d.text AS was, n.text AS now, unnest(range(0, (length(d.text) + 1499) // 1500)) AS r FROM documents d LEFT JOIN now n ON n.doc_id = d.doc_id)
SELECT doc_id, r::INTEGER AS region, CASE WHEN now IS NULL THEN 'unknown-source' WHEN was <> now THEN 'source-changed' END AS fault FROM r""")
def staleness_check(t: Tables) -> DataFrame:
    now = t.documents.where("lang <> 'fr'").select("doc_id", F.when(F.col("lang") == "de", F.replace("text", F.lit(" und "), F.lit(" oder "))).otherwise(F.col("text")).alias("text"))
    hashes = t.documents.select("doc_id", F.sha2("text", 256).alias("was")).join(now.select("doc_id", F.sha2("text", 256).alias("now")), "doc_id", "left")
    return E.region_faults(units.regions(t.documents, "doc_id", "text", 1500, 200), units.regions(now, "doc_id", "text", 1500, 200), hashes)


@query("T18", """
SELECT doc_id, r::INTEGER AS region, CASE WHEN was[r + 1] <> now[r + 1] THEN 'text-differs' WHEN r > 0 AND was[r] <> now[r] OR r + 1 < len(was) AND was[r + 2] <> now[r + 2] THEN 'context-differs' END AS fault
FROM (SELECT doc_id, was, now, unnest(range(0, len(was))) AS r FROM (
  SELECT doc_id, list_transform(range(0, (length(text) + 99) // 100), lambda i: substr(text, i * 100 + 1, 100)) AS was, list_transform(range(0, (length(text) + 99) // 100), lambda i: substr(translate(text, 'q', 'Q'), i * 100 + 1, 100)) AS now FROM documents))""")
def region_text_check(t: Tables) -> DataFrame:
    """Every region and both its contexts, where the whole's hash is held to be the same."""
    now = t.documents.select("doc_id", F.translate("text", "q", "Q").alias("text"))
    same = t.documents.select("doc_id", F.lit("-").alias("was"), F.lit("-").alias("now"))
    return E.region_faults(units.regions(t.documents, "doc_id", "text", 100, 100), units.regions(now, "doc_id", "text", 100, 100), same)


@query("T16 J16", f"""
WITH {NODES.sql}, {LINKS.sql}, r AS (SELECT * FROM nodes WHERE kind = 'region'),
near AS (SELECT a.id, list(b.id ORDER BY b.region_index) AS neighbours FROM r a JOIN r b ON a.source_id = b.source_id AND a.id <> b.id AND abs(a.region_index - b.region_index) <= 2 GROUP BY a.id),
live AS (SELECT l.* FROM links l JOIN nodes a ON a.id = src AND a.fingerprint = src_fp JOIN nodes b ON b.id = dst AND b.fingerprint = dst_fp),
two AS (SELECT src AS id, dst AS other, cosine FROM live UNION ALL SELECT dst, src, cosine FROM live),
each_ AS (SELECT id, other, max(cosine) AS cosine FROM two GROUP BY id, other), best AS (SELECT * FROM each_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) <= 3),
alike AS (SELECT id, list(other ORDER BY cosine DESC, other) AS alike FROM best GROUP BY id)
SELECT r.id, text, coalesce(neighbours, []) AS neighbours, coalesce(alike, []) AS alike, fingerprint <> stored AS stale FROM r LEFT JOIN near ON near.id = r.id LEFT JOIN alike ON alike.id = r.id""")
def read_region(t: Tables) -> DataFrame:
    # links and neighbours are worked out on digests, of which fingerprints tell the same; texts go to their views alone
    lean = Digested.of(t)
    marks = NODES.frame(lean).select("id", "kind", "source_id", "region_index", "fingerprint")
    best = E.current_links(LINKS.frame(lean), marks).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other"))).alias("a"))
    near = E.neighbourhood(marks.where("kind = 'region'"), 2).drop("source_id")
    none = F.array().cast("array<string>")
    regions = NODES.frame(t).where("kind = 'region'").select("id", "text", (F.col("fingerprint") != F.col("stored")).alias("stale"))
    return regions.join(near, "id").join(best, "id", "left").select("id", "text", "neighbours", F.coalesce(F.transform("a", lambda x: x["other"]), none).alias("alike"), "stale")


@query("T17 W10 W11 M10", f"""
WITH {HEADINGS.sql}, {PAGE_COUNTS.sql}
SELECT h.source_id, h.ord, h.level, h.title, h.page AS first_page,
  greatest(h.page, coalesce((SELECT n.page FROM headings n WHERE n.source_id = h.source_id AND n.ord > h.ord AND n.level <= h.level ORDER BY n.ord LIMIT 1), pages)) AS last_page,
  (SELECT max(p.ord) FROM headings p WHERE p.source_id = h.source_id AND p.ord < h.ord AND p.level < h.level) AS parent
FROM headings h JOIN page_counts USING (source_id)""")
def navigation_ranges(t: Tables) -> DataFrame:
    return E.sections(HEADINGS.frame(t), PAGE_COUNTS.frame(t))


@query("T17", f"""
WITH {NODES.sql} SELECT source_id, string_agg(text, chr(10) || chr(10) ORDER BY region_index) AS section, sum(length(text))::BIGINT AS n_chars FROM nodes WHERE kind = 'region' AND region_index BETWEEN 1 AND 2 GROUP BY source_id""")
def read_section(t: Tables) -> DataFrame:
    rows = NODES.frame(t).where("kind = 'region' and region_index between 1 and 2")
    parts = rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("region_index", "text"))).alias("x"), F.sum(F.char_length("text")).alias("n_chars"))
    return parts.select("source_id", F.array_join(F.transform("x", lambda x: x["text"]), "\n\n").alias("section"), "n_chars")


@query("T19 R6 P7", f"""
WITH {CLAIMS.sql}, {NODES.sql}
SELECT claim, CASE WHEN n.id IS NULL THEN 'unknown-region' WHEN fingerprint <> stored THEN 'stale-region' WHEN trim(coalesce(quote, '')) = '' THEN 'no-quote' WHEN NOT contains(text, quote) THEN 'quote-not-found' END AS fault
FROM claims c LEFT JOIN nodes n ON n.id = c.region_id""")
def quote_check(t: Tables) -> DataFrame:
    nodes = NODES.frame(t).select("id", "text", (F.col("fingerprint") != F.col("stored")).alias("stale"))
    return E.anchored_claims(CLAIMS.frame(t), nodes)
