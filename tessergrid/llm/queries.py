"""The queries of this subpackage: one per operator, over whole tables, with the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_views, decontaminate, language_mix, line_dedup, near_duplicates, page_text, phrases, repeats, tokenize_bpe, toxicity_chain, vector_search, window_dedup
from .textops import table

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


def op2_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mix.language_report(table(spark, sf_dir, "documents"))


def op3_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_views.perspective_report(table(spark, sf_dir, "conversations"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_bpe.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), RANK_FILE, PATTERN)


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    train_on = ~language_mix.held_out(F.col("doc_id"))
    return toxicity_chain.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train_on=train_on)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op11_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.window_report(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_decontaminate, op2_language_mix, op3_chat_views, op4_byte_bpe, op5_vector_search, op6_page_text, op7_repeated_bytes, op8_toxicity_chain, op9_line_dedup, op10_ngram_join, op11_repeated_windows, op12_phrases)
    return {f.__name__: f for f in made}


#: Those of the queries that SQL can express; the others are tested against brute force, round trips or held-out accuracy.
OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), pos AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, p, pos.n AS n, item FROM pos JOIN win ON pos.s = win.s AND pos.n = win.n
), words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id
), items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


# strings of 50 bytes are compared as 100 hexadecimal digits; a run goes on while the next string starts within it
OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), cut AS (SELECT doc_id, c, h[2 * c + 1:2 * c + 1098] AS h FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0), 500)) AS c FROM d)
), w AS (SELECT doc_id, c + p AS p, h[2 * p + 1:2 * p + 100] AS s FROM (SELECT doc_id, c, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM cut)
), least AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), r AS (SELECT doc_id, p FROM w JOIN least USING (s) WHERE m < doc_id
), mark AS (SELECT *, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -99) + 50 AS new FROM r
), run AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM mark) GROUP BY doc_id, k
), gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM run UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(len(h)) // 2 FROM d LEFT JOIN run ON run.doc_id = d.doc_id GROUP BY d.doc_id
), kept AS (SELECT doc_id, string_agg(h[2 * x + 1:2 * y], '' ORDER BY x) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id
), n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM run GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# lines meet on any of their rarest words; whoever shares none of them has a Jaccard similarity under 0.8
OP9_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), s AS (SELECT doc_id, no, line, list_distinct(regexp_extract_all(lower(line), '{_WORDS}')) AS w FROM l
), k AS (SELECT min((doc_id, no)) AS first, list_sort(w) AS w FROM s WHERE len(w) > 0 GROUP BY list_sort(w)
), f AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM k) GROUP BY x
), o AS (SELECT first, w, x, row_number() OVER (PARTITION BY first ORDER BY n, x) AS place FROM (SELECT first, w, unnest(w) AS x FROM k) JOIN f USING (x)
), p AS (SELECT * FROM o WHERE place <= len(w) - ceil(0.8 * len(w) - 1e-9) + 1
), near AS (SELECT DISTINCT b.first FROM p a JOIN p b ON a.x = b.x AND a.first < b.first AND len(a.w) >= 0.8 * len(b.w) - 1e-9 AND len(b.w) >= 0.8 * len(a.w) - 1e-9 WHERE len(list_intersect(a.w, b.w)) * 1.8 >= (len(a.w) + len(b.w)) * 0.8 - 1e-9
), gone AS (SELECT s.doc_id, s.no FROM s JOIN k ON list_sort(s.w) = k.w WHERE len(s.w) > 0 AND ((s.doc_id, s.no) <> k.first OR k.first IN (SELECT first FROM near))
), kept AS (SELECT s.doc_id, count(*) AS n, count(g.no) AS r, string_agg(line, chr(10) ORDER BY s.no) FILTER (WHERE g.no IS NULL) AS kept FROM s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.no = s.no GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS kept FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# every two documents with a common n-gram are compared on their whole sets
OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents
), g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d WHERE len(w) > 0
), c AS (SELECT min(doc_id) AS copy_of, count(*) AS weight, g FROM g GROUP BY g
), e AS (SELECT copy_of, unnest(g) AS x, len(g) AS n FROM c
), m AS (SELECT a.copy_of AS a, b.copy_of AS b FROM e a JOIN e b ON a.x = b.x AND a.copy_of <> b.copy_of GROUP BY a.copy_of, b.copy_of, a.n, b.n HAVING count(*) * 9 >= (a.n + b.n) * 4
), r(a, b) AS (SELECT copy_of, copy_of FROM c UNION SELECT r.a, m.b FROM r JOIN m ON m.a = r.b
), cls AS (SELECT a AS copy_of, min(b) AS class_id FROM r GROUP BY a
), n AS (SELECT m.a AS copy_of, count(*) AS sets, sum(weight) AS docs FROM m JOIN c ON c.copy_of = m.b GROUP BY m.a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(c.copy_of, d.doc_id) AS copy_of, (coalesce(docs, 0) + coalesce(weight, 1) - 1)::BIGINT AS n_links, coalesce(sets, 0)::BIGINT AS n_text_links
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN c ON c.g = g.g LEFT JOIN cls ON cls.copy_of = c.copy_of LEFT JOIN n ON n.copy_of = c.copy_of
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op3_chat_views": chat_views.SQL, "op5_vector_search": OP5_SQL, "op7_repeated_bytes": OP7_SQL, "op9_line_dedup": OP9_SQL, "op10_ngram_join": OP10_SQL, "op11_repeated_windows": window_dedup.SQL, "op12_phrases": phrases.SQL}
