"""Rules of the materials ledger, over listings read from the given tables; tests run them on awkward listings too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..registry import query
from ..session import Tables
from . import fixtures as X
from .bound import Bound
from .fixtures import sql_value

# One in ten numbers has the right check digit.
_ISBN = "concat('978', lpad(CAST(l_partkey % 40 AS STRING), 9, '0'), CAST(l_suppkey % 10 AS STRING))"
_TITLE = """CASE l_suppkey % 17 WHEN 0 THEN 'No textbooks are required for this course.' WHEN 1 THEN 'None' WHEN 2 THEN 'TBA by instructor' WHEN 3 THEN 'All readings on Canvas' WHEN 4 THEN 'i>clicker'
      WHEN 5 THEN concat('<b>', p_name, ' &amp; ', p_brand, '</b>') WHEN 6 THEN '' ELSE concat(p_name, ' ', p_brand) END"""
LISTED = Bound(X.LISTED, f"""
    SELECT CAST(l_orderkey AS STRING) AS course_key, l_linenumber AS line, CASE p_size % 9 WHEN 0 THEN 'Book' WHEN 1 THEN 'text_book' WHEN 2 THEN 'textbook' WHEN 3 THEN 'reading' WHEN 4 THEN 'device' WHEN 5 THEN 'book chapter' WHEN 6 THEN 'No textbook statement' WHEN 7 THEN 'e-book' ELSE 'monograph' END AS kind,
      {_TITLE} AS title, CASE l_partkey % 4 WHEN 0 THEN concat(p_name, '. ISBN: ', {_ISBN}) WHEN 1 THEN concat('ISBN ', {_ISBN}, ' and later ISBN 0306406152') END AS citation, CASE WHEN l_partkey % 3 <> 0 THEN p_type END AS authors, CASE p_size % 4 WHEN 0 THEN '2' WHEN 1 THEN '' END AS edition,
      CASE WHEN l_linenumber % 3 = 0 THEN {_ISBN} END AS isbn, CASE l_linenumber WHEN 3 THEN 'valid checksum' WHEN 6 THEN 'not checked' END AS isbn_validation, CASE WHEN l_partkey % 13 = 0 THEN concat('ISBN:', {_ISBN}) END AS recurrence_key,
      CASE WHEN l_suppkey % 8 = 1 THEN 'library-course-reserve-candidate' END AS association, CASE WHEN l_suppkey % 9 = 2 THEN false END AS eligible, CASE WHEN l_suppkey % 2 = 0 THEN 'said so' END AS excerpt, CASE WHEN l_partkey % 31 = 0 THEN 'description' END AS source_field,
      CASE l_partkey % 10 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'no' END AS book_flag, CASE WHEN l_suppkey % 16 = 1 THEN split(concat(p_name, ' ', p_brand, ' ,another'), ',') END AS library_titles FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey
    UNION ALL SELECT concat('d', CAST(doc_id AS STRING)), 0, CASE WHEN doc_id % 2 = 0 THEN 'book' ELSE 'reading' END, CASE WHEN doc_id % 3 = 0 THEN text ELSE split_part(text, '.', 1) END, NULL, source, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {{documents}}""")  # fmt: skip
LEDGERS = Bound(X.LEDGERS, """
    SELECT CAST(o_orderkey AS STRING) AS course_key, CASE o_custkey % 9 WHEN 0 THEN 'found' WHEN 1 THEN 'searched-no-public-material' WHEN 2 THEN 'source-access-limited' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'searched-no-book-evidence' WHEN 5 THEN 'has-saved-reference-records' WHEN 6 THEN 'zzz-other' ELSE 'found' END AS status,
      CASE o_custkey % 5 WHEN 0 THEN split('ambiguous', ',') WHEN 1 THEN split('not-researched,found', ',') END AS more, CASE WHEN o_custkey % 4 <> 0 THEN concat('https://x.example/', CAST(o_custkey AS STRING)) END AS source, CASE o_custkey % 6 WHEN 0 THEN 'later terms' WHEN 1 THEN '' END AS gap FROM {orders} WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT CAST(o_orderkey AS STRING), 'found', NULL, 'https://y.example', NULL FROM {orders} WHERE o_orderkey % 4 = 1""")  # fmt: skip
LISTED_COURSES = Bound(X.LISTED_COURSES, """
    SELECT CAST(o_orderkey AS STRING) AS course_key, CASE o_custkey % 9 WHEN 0 THEN 'Found online' WHEN 1 THEN 'Login required' WHEN 2 THEN 'No public material' WHEN 3 THEN 'saved reference' WHEN 4 THEN 'not a reference' WHEN 5 THEN ' searched_no book evidence' WHEN 6 THEN 'AMBIGUOUS but found' END AS research_status,
      CASE WHEN o_custkey % 4 = 0 THEN o_orderpriority WHEN o_custkey % 4 = 1 THEN '' END AS note, CASE WHEN o_custkey % 7 = 0 THEN 'https://c.example' END AS source_url FROM {orders}""")  # fmt: skip
RESOLUTIONS = Bound(X.RESOLUTIONS, f"""
    SELECT CAST(l_orderkey AS STRING) AS course_key, {_TITLE} AS title, min({_ISBN}) AS isbn, min(l_suppkey) % 4 = 0 AS confirmed FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey WHERE l_suppkey % 7 = 0 GROUP BY 1, 2""")  # fmt: skip

_RULES = ", ".join(map(sql_value, L.NO_RESOURCE))
_LABEL = r"(?i)\bISBN(?:-1[03])?\s*:?\s*([0-9Xx][0-9Xx\- ]{8,20}[0-9Xx])\b"


def _plain(x: str) -> str:
    text = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))"


#: Every listing with what it states and what it is; ISBNs are worked out once for each spelling.
RULES = rf"""
{LISTED.sql}, p AS (
  SELECT *, coalesce(title, '') AS t, regexp_replace({_plain('title')}, '^[ .;:,-]+|[ .;:,-]+$', '', 'g') AS said, translate({_plain('kind')}, '_-', '  ') AS kind_name, regexp_replace(coalesce(title, ''), '<[^>]*>', ' ', 'g') AS body FROM listed
), q AS (
  SELECT *, len(list_filter([{_RULES}], lambda x: regexp_matches(said, x))) > 0 AS nothing FROM p
), r AS (
  SELECT *, CASE WHEN nothing AND regexp_matches(said, {sql_value(L.NO_BOOK)}) THEN 'explicit-no-textbook-stated' WHEN regexp_matches(said, {sql_value(L.BEHIND_LOGIN)}) THEN 'source-access-limited'
      WHEN nothing OR regexp_matches(said, {sql_value(L.STILL_OPEN)}) THEN 'ambiguous' END AS text_states,
    kind_name = 'textbook requirement statement' OR regexp_matches(kind_name, '\bno (?:required )?textbooks?\b') AS denies,
    length(trim(body)) > 280 OR regexp_matches(body, '\n\s*\n') OR len(regexp_extract_all(body, '(?:^|[\r\n])\s*\d+[.)]\s+')) > 1 OR len(regexp_extract_all(body, '(?i)\bISBN(?:-1[03])?\b')) > 1 AS block,
    kind_name IN ('textbook requirement statement', 'no textbook statement', 'assigned reading statement', 'reading availability statement', 'required reading statement') AS statement
  FROM q
), s AS (
  SELECT *, CASE WHEN denies THEN 'explicit-no-textbook-stated' ELSE text_states END AS states,
    coalesce(eligible, true) AND NOT statement AND t <> '' AND NOT nothing AND (
      coalesce(association, '') = 'library-course-reserve-candidate' AND kind_name = 'book' AND len(list_filter(coalesce(library_titles, []), lambda x: trim(x) = trim(t))) > 0
      OR text_states IS NULL AND NOT block AND NOT regexp_matches(t, '(?i)^catalog description explicitly (?:states|says)\b')) AS is_resource,
    statement OR denies OR (eligible = false AND coalesce(excerpt, '') <> '') IS TRUE OR coalesce(source_field, '') <> '' OR block AS is_evidence
  FROM r
), rules AS (
  SELECT *, is_resource AND CASE WHEN lower(trim(book_flag)) IN ('t', 'true', 'yes', '1') THEN true WHEN lower(trim(book_flag)) IN ('f', 'false', 'no', '0') THEN false
      ELSE NOT regexp_matches(kind_name, 'chapter|statement|block') AND regexp_matches(kind_name, '\b(?:book|textbook|e ?book|monograph|workbook)\b') END AS is_book FROM s
), classified AS (
  SELECT *, is_book AND kind_name NOT IN ('device', 'equipment', 'calculator', 'classroom response device', 'supplies') AND NOT regexp_matches(trim(split_part(t, ' / ', 1)),
    '(?i)^(?:(?:ELEGOO\s+)?UNO R3 SUPER STARTER KIT|i[ -]?clicker(?:\s*(?:2|plus|\+))?(?:\s+(?:student\s+)?(?:remote|remote control|response device))?)$') AS is_learning_book FROM rules
), spelled AS (
  SELECT isbn AS x FROM listed WHERE isbn <> '' UNION SELECT substr(recurrence_key, 6) FROM listed WHERE lower(recurrence_key) LIKE 'isbn:%'
  UNION SELECT unnest(regexp_extract_all(concat_ws(' ', coalesce(citation, ''), t), '{_LABEL}', 1)) FROM p UNION SELECT trim(unnest(regexp_extract_all(concat_ws(' ', coalesce(citation, ''), t), '{_LABEL}', 1))) FROM p
), digits AS (SELECT x, upper(regexp_replace(x, '[^0-9Xx]', '', 'g')) AS d FROM spelled), canon AS (
  SELECT x, CASE WHEN regexp_full_match(d, '[0-9]{{9}}[0-9X]') AND (list_sum(list_transform(range(1, 10), lambda i: (11 - i) * try_cast(d[i] AS INT))) + CASE d[10] WHEN 'X' THEN 10 ELSE try_cast(d[10] AS INT) END) % 11 = 0
      THEN '978' || d[1:9] || ((10 - list_sum(list_transform(range(1, 13), lambda i: try_cast(('978' || d[1:9])[i] AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10)::INT
    WHEN regexp_full_match(d, '[0-9]{{13}}') AND list_sum(list_transform(range(1, 14), lambda i: try_cast(d[i] AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 THEN d ELSE '' END AS c FROM digits
), known AS (SELECT map_from_entries(list((x, c))) AS m FROM canon), isbns AS (
  SELECT *, lower(coalesce(recurrence_key, '')) LIKE 'isbn:%' AS keyed, regexp_extract_all(concat_ws(' ', coalesce(citation, ''), t), '{_LABEL}', 1) AS cited,
    list_transform(regexp_extract_all(coalesce(citation, ''), '{_LABEL}', 1) || regexp_extract_all(t, '{_LABEL}', 1), lambda x: trim(x)) AS every, list_filter(every, lambda x, i: list_position(every, x) = i) AS tokens FROM classified, known
), named AS (
  SELECT *, CASE WHEN coalesce(isbn, '') = '' AND coalesce(association, '') = 'library-course-reserve-candidate' THEN '' WHEN coalesce(isbn, '') = '' AND NOT keyed THEN coalesce(list_filter(list_transform(cited, lambda x: m[x]), lambda x: x <> '')[1], '')
      WHEN keyed OR lower(isbn_validation) LIKE 'valid%' OR contains(lower(isbn_validation), 'checksum valid') THEN CASE WHEN coalesce(isbn, '') <> '' THEN m[isbn] ELSE m[substr(recurrence_key, 6)] END ELSE '' END AS own_isbn FROM isbns
), sourced AS (
  SELECT *, CASE WHEN coalesce(isbn, '') <> '' THEN isbn WHEN len(tokens) > 0 THEN array_to_string(tokens, '; ') ELSE own_isbn END AS raw,
    CASE WHEN coalesce(isbn, '') <> '' THEN CASE WHEN m[isbn] LIKE '978%' OR m[isbn] LIKE '979%' THEN m[isbn] ELSE '' END
      WHEN len(tokens) > 0 THEN CASE WHEN len(list_distinct(list_transform(tokens, lambda x: CASE WHEN m[x] LIKE '97%' THEN m[x] ELSE '' END))) = 1 THEN m[tokens[1]] ELSE '' END ELSE own_isbn END AS sisbn FROM named
)"""


@query("F6 F7 F8", f"WITH {RULES} SELECT course_key, line, kind_name, states, is_resource, is_evidence, is_book, is_learning_book FROM classified")
def material_rules(t: Tables) -> DataFrame:
    return L.classified(LISTED.frame(t)).select("course_key", "line", "kind_name", "states", "is_resource", "is_evidence", "is_book", "is_learning_book")


@query("E2 E4 E11", rf"""
WITH {RULES}, ids AS (SELECT *, {_plain('title')} AS nt, {_plain('authors')} AS na, {_plain('edition')} AS ne FROM sourced)
SELECT course_key, line, own_isbn, raw, sisbn AS source_isbn,
  CASE WHEN NOT is_resource THEN NULL WHEN own_isbn <> '' THEN 'isbn:' || own_isbn WHEN na <> '' THEN 'citation:' || nt || '|' || na || '|' || ne WHEN ne <> '' THEN 'title-edition:' || nt || '|' || ne ELSE 'title-candidate:' || nt END AS key,
  CASE WHEN NOT is_resource THEN NULL WHEN own_isbn <> '' THEN 'checksum-valid ISBN' WHEN na <> '' THEN 'normalized title, author, and edition' WHEN ne <> '' THEN 'normalized exact title and edition' ELSE 'normalized exact title/citation' END AS basis
FROM ids""")
def material_identities(t: Tables) -> DataFrame:
    own = F.col("own")
    rows = L.classified(LISTED.frame(t)).withColumn("own", L.own_isbn()).withColumns({"s": L.source_isbn(own), "i": L.book_identity(own)})
    return rows.select("course_key", "line", F.col("own").alias("own_isbn"), "s.raw", F.col("s.isbn").alias("source_isbn"), "i.key", "i.basis")


@query("A4 F8", rf"""
WITH {RULES}, {LEDGERS.sql}, {LISTED_COURSES.sql}, mats AS (
  SELECT course_key, list(DISTINCT states) FILTER (WHERE states IS NOT NULL) AS texts, bool_or(is_resource) AS resources, bool_or(is_evidence) AS evidence, count(*) AS n FROM (SELECT DISTINCT * FROM classified) GROUP BY course_key
), said AS (
  SELECT course_key, list_sort(list_distinct(flatten(list([status] || coalesce(more, []))))) AS said, list_sort(list(DISTINCT source) FILTER (WHERE source IS NOT NULL)) AS sources, list_sort(list(DISTINCT gap) FILTER (WHERE gap <> '')) AS gaps FROM ledgers GROUP BY course_key
), j AS (
  SELECT c.*, coalesce(said, []) AS s, coalesce(texts, []) AS x, coalesce(resources, false) AS res, coalesce(evidence, false) AS ev, coalesce(n, 0) AS n, coalesce(sources, []) AS src, coalesce(gaps, []) AS g, translate(lower(trim(coalesce(research_status, ''))), '_ ', '--') AS f
  FROM listed_courses c LEFT JOIN said ON said.course_key = c.course_key LEFT JOIN mats ON mats.course_key = c.course_key
), k AS (
  SELECT *, CASE WHEN 'found' IN s AND res THEN 'found' WHEN 'explicit-no-textbook-stated' IN x OR 'explicit-no-textbook-stated' IN s THEN 'explicit-no-textbook-stated' WHEN 'source-access-limited' IN s OR 'source-access-limited' IN x THEN 'source-access-limited'
    WHEN 'found' IN s AND ev THEN 'found' WHEN 'searched-no-public-material' IN s THEN 'searched-no-public-material' WHEN 'ambiguous' IN s OR 'ambiguous' IN x THEN 'ambiguous' WHEN 'searched-no-book-evidence' IN s THEN 'searched-no-book-evidence'
    WHEN 'has-saved-reference-records' IN s THEN 'has-saved-reference-records' WHEN 'found' IN s THEN 'searched-no-public-material' WHEN len(s) > 0 THEN s[1]
    WHEN f IN {tuple(L.STATUSES)} THEN f WHEN f LIKE '%ambiguous%' THEN 'ambiguous' WHEN regexp_matches(f, 'access-limited|login|restricted') THEN 'source-access-limited' WHEN regexp_matches(f, 'no-public-material|no-material') THEN 'searched-no-public-material'
    WHEN f LIKE '%found%' THEN 'found' WHEN f LIKE '%reference%' AND f NOT LIKE '%not%' THEN 'has-saved-reference-records' ELSE 'not-researched' END AS status FROM j
)
SELECT course_key, status, s AS evidence_statuses, n AS n_materials, CASE WHEN len(src) > 0 THEN src WHEN source_url IS NOT NULL THEN [source_url] ELSE [] END AS sources,
  CASE WHEN len(g) > 0 THEN g WHEN coalesce(note, '') <> '' THEN [note] WHEN status = 'not-researched' THEN ['Per-course books and other learning materials have not been researched in this source pass.'] ELSE [] END AS gaps FROM k""")
def course_entries(t: Tables) -> DataFrame:
    return L.course_entries(LISTED_COURSES.frame(t), LEDGERS.frame(t), LISTED.frame(t))


_MATCHED = rf"""
{RULES}, {RESOLUTIONS.sql}, j AS (
  SELECT s.*, r.isbn AS resolved, r.confirmed, coalesce(association, '') = 'library-course-reserve-candidate' AS reserve, CASE WHEN m[s.isbn] LIKE '97%' THEN m[s.isbn] ELSE '' END AS held
  FROM sourced s LEFT JOIN resolutions r ON r.course_key = s.course_key AND r.title = s.title WHERE is_learning_book
), matched AS (
  SELECT course_key, line, CASE WHEN reserve THEN '' ELSE sisbn END AS assigned, CASE WHEN confirmed THEN resolved WHEN reserve THEN '' ELSE sisbn END AS matched,
    CASE WHEN NOT confirmed THEN resolved WHEN reserve THEN held ELSE '' END AS candidate,
    CASE WHEN confirmed THEN 'publisher-edition-matched' WHEN NOT confirmed THEN 'publisher-edition-unconfirmed' WHEN reserve AND held <> '' THEN 'library-reserve-candidate' WHEN reserve THEN 'missing'
      WHEN sisbn <> '' THEN 'course-source-isbn' WHEN raw <> '' THEN 'invalid-course-source-isbn' ELSE 'missing' END AS status,
    CASE WHEN reserve THEN 'library-bibliography' WHEN raw <> '' THEN 'course-citation' ELSE 'not-stated' END AS origin,
    resolved IS NOT NULL AND (raw <> '' AND sisbn = '' OR sisbn <> '' AND sisbn <> resolved) AS conflict FROM j
)"""


@query("E10", f"WITH {_MATCHED} SELECT * FROM matched")
def match_ladder(t: Tables) -> DataFrame:
    return L.book_matches(LISTED.frame(t), RESOLUTIONS.frame(t))


@query("A9", f"""
WITH {_MATCHED} SELECT count(*) AS mappings, count(DISTINCT course_key) AS courses, count(*) FILTER (WHERE assigned <> '') AS course_source_isbn, count(*) FILTER (WHERE status = 'publisher-edition-matched') AS publisher_matched,
  count(*) FILTER (WHERE status = 'library-reserve-candidate') AS reserve_candidates, count(*) FILTER (WHERE candidate <> '') AS candidates, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'invalid-course-source-isbn') AS invalid,
  count(*) FILTER (WHERE assigned = '' AND matched = '' AND candidate = '') AS without_any_isbn, count(*) FILTER (WHERE conflict) AS conflicts FROM matched""")
def match_summary(t: Tables) -> DataFrame:
    return L.summary(L.book_matches(LISTED.frame(t), RESOLUTIONS.frame(t)))
