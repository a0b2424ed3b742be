"""Matching requirements to courses, ranking, selection and acquisition, over courses made of parts and documents; tests run them on awkward courses too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching as M
from ..registry import query
from ..session import Tables
from . import fixtures as X
from . import retrieval
from .bound import AwkwardRows, Bound, Clause, Words
from .fixtures import sql_value

# What is asked of parts and documents; the same kinds of requirements as those for the awkward courses.
REQUIREMENTS = Words(("design cold anvil", "gizmo", "choose ring", "interpret erst ther", "blue gizmo", "hot plate", "widget", "old gear and new rod"), X.REQUIREMENTS)
SEARCH_TERMS = {"design cold anvil": ["anvil design", "anvil"], "interpret erst ther": ["ther interpretation"]}
AROUND, MUST = Words(("widget",), ("robot",)), Words(("blue gizmo",), ("control structures",))


def _wordings(asked: tuple[str, ...], search_terms: dict[str, list[str]], context: str) -> str:
    made = M.compile_wordings(list(asked), search_terms, context)
    return ", ".join(f"({', '.join(sql_value(v) for v in (w.requirement, w.place, w.query, w.wanted, w.subjects, w.task, w.action, w.asks_work, w.choosing, w.in_context, ' '.join(M.normal_words(w.query))))})" for w in made)


ASKED = Clause(_wordings(REQUIREMENTS.given, SEARCH_TERMS, "widget expert"), _wordings(X.REQUIREMENTS, X.SEARCH_TERMS, X.CONTEXT))

COURSE_FIELDS = Bound(X.COURSE_FIELDS, """
    SELECT concat('p', CAST(p_partkey AS STRING)) AS course_id, 'title' AS field, p_name AS text FROM {part}
    UNION ALL SELECT concat('p', CAST(a.p_partkey AS STRING)), 'description', concat('Students design a ', a.p_name, ' and a ', b.p_name, '. They choose among a ', b.p_name, ', or interpret ', a.p_name, '; for experts.') FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey * 7 % 1000 WHERE a.p_partkey % 4 <> 0
    UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 'academic_areas', concat(p_name, ' ', p_type) FROM {part} WHERE p_partkey % 5 = 0
    UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 'code', concat(p_brand, ' ', p_name) FROM {part} WHERE p_partkey % 3 = 0
    UNION ALL SELECT concat('d', CAST(doc_id AS STRING)), 'title', split_part(text, '.', 1) FROM {documents}
    UNION ALL SELECT concat('d', CAST(doc_id AS STRING)), 'description', text FROM {documents}""")  # fmt: skip
COURSES = Bound(X.COURSES, """
    SELECT concat('p', CAST(p_partkey AS STRING)) AS course_id, CASE WHEN p_size % 3 = 0 THEN 'reviewed' ELSE 'unknown' END AS classified, p_partkey % 9 <> 0 AS named_material FROM {part}
    UNION ALL SELECT concat('d', CAST(doc_id AS STRING)), CASE WHEN lang = 'en' THEN 'reviewed' ELSE 'unknown' END, doc_id % 4 <> 0 FROM {documents}""")  # fmt: skip
REVIEWS = Bound(X.REVIEWS, f"""
    SELECT concat(CASE WHEN o_custkey % 3 = 0 THEN 'd' ELSE 'p' END, CAST(o_custkey AS STRING)) AS course_id, element_at(split('{",".join(REQUIREMENTS.given)}', ','), CAST(o_orderkey % 8 + 1 AS INT)) AS requirement,
      CASE o_orderkey % 7 WHEN 0 THEN 'essential' WHEN 1 THEN 'supplemental' ELSE 'reject' END AS decision, 'title' AS field, '' AS quote, o_orderkey AS at FROM {{orders}} WHERE o_orderstatus = 'P'""")  # fmt: skip
SIMILARITIES = Bound(X.SIMILARITIES, """
    SELECT concat('p', CAST(vec_id AS STRING)) AS course_id, 'gizmo' AS requirement, element_at(embedding, 1) AS similarity FROM {embeddings}
    UNION ALL SELECT concat('p', CAST(vec_id AS STRING)), 'hot plate', element_at(embedding, 2) FROM {embeddings} WHERE vec_id % 3 = 0""")  # fmt: skip
PRIORITIES = Bound(X.PRIORITIES, "SELECT p_name AS requirement, CASE WHEN count(*) % 2 = 0 THEN 'essential' ELSE 'supplemental' END AS priority FROM {part} GROUP BY p_name")
STRENGTH = Bound(X.STRENGTH, """
    SELECT 'hot plate' AS requirement, concat('p', CAST(p_partkey AS STRING)) AS course_id, 'qs' AS provider, 2024 AS year, 'a' AS subject, 'v1' AS version, p_size * 4 AS low, p_size * 4 + p_size % 4 AS high FROM {part}
    UNION ALL SELECT 'widget', concat('p', CAST(p_partkey AS STRING)), 'qs', 2024, 'a', 'v1', p_size, p_size + p_size % 4 FROM {part} WHERE p_size > 3
    UNION ALL SELECT 'widget', concat('p', CAST(p_partkey AS STRING)), 'the', 2023 + p_size % 2, 'a', 'v2', p_size, p_size + 2 FROM {part}""")  # fmt: skip
MATERIALS = Bound(X.MATERIALS, """
    SELECT CAST(l_orderkey AS STRING) AS course_id, CASE WHEN l_returnflag = 'R' THEN 'must-have' ELSE 'supplemental' END AS course_role, CAST(l_suppkey AS STRING) AS source_key, l_linenumber * 1000000 + l_partkey AS line, p_name AS key,
      CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE p_brand END AS authors, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(p_size % 3 + 1 AS STRING) END AS edition, CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey % 4 <> 1 END AS verified,
      CASE l_linenumber WHEN 1 THEN 'required' WHEN 2 THEN 'Optional' WHEN 3 THEN 'not required' WHEN 4 THEN 'recommended, required for majors' WHEN 5 THEN 'primary' END AS reading_role FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""")  # fmt: skip

_FORMS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.WORD_FORMS.items()) + "}"
_IN = lambda values: "(" + ", ".join(map(sql_value, values)) + ")"

#: (course_id, requirement, ...): windows are found by trying every two occurrences as ends.
MATCH_SQL = f"""
{COURSE_FIELDS.sql},
asked(requirement, place, query, wanted, subjects, task, action, asks_work, choosing, in_context, phrase) AS (VALUES {ASKED.sql}),
cut AS (SELECT course_id, field, unnest(CASE WHEN field IN {_IN(M.TEACHING)} THEN string_split(regexp_replace(text, '([.!?;])\\s+|\\n+', '\\1' || chr(30), 'g'), chr(30)) ELSE [text] END) AS passage FROM course_fields),
tok AS (SELECT *, list_transform(regexp_extract_all(lower(passage), '[\\pL\\pN_]+'), lambda w: coalesce(({_FORMS})[w], w)) AS words FROM cut),
heard AS (SELECT *, list_distinct(list_filter(words, lambda w: w NOT IN {_IN(T.PLAN_STOP_WORDS)})) AS said FROM tok),
met AS (SELECT row_number() OVER () AS k, h.*, a.*, list_filter(wanted, lambda w: list_contains(said, w)) AS found, list_filter(subjects, lambda w: list_contains(said, w)) AS subj
  FROM heard h JOIN asked a ON list_has_any(said, wanted)),
occ AS (SELECT * FROM (SELECT k, wanted, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS w FROM met) WHERE list_contains(wanted, w) OR w IN {_IN(M.CHOOSING)}),
ends AS (SELECT a.k, a.p AS a, b.p AS b FROM occ a JOIN occ b ON a.k = b.k AND a.p <= b.p),
inside AS (SELECT e.k, e.a, e.b, list(DISTINCT o.w) AS ws FROM ends e JOIN occ o ON o.k = e.k AND o.p BETWEEN e.a AND e.b GROUP BY ALL),
spans AS (SELECT m.k, min(b - a) FILTER (WHERE list_has_all(ws, found)) AS found_span, min(b - a) FILTER (WHERE list_has_all(ws, subj)) AS subj_span FROM met m JOIN inside i ON i.k = m.k GROUP BY m.k),
near AS (SELECT a.k FROM occ a JOIN occ b ON a.k = b.k JOIN met m ON m.k = a.k WHERE a.w IN {_IN(M.CHOOSING)} AND list_contains(m.wanted, b.w) AND b.w NOT IN {_IN(M.CHOOSING)} AND abs(a.p - b.p) <= 3 GROUP BY a.k),
kept AS (SELECT m.*, CASE WHEN len(subjects) > 0 THEN len(subj) / len(subjects) ELSE 0.0 END AS part FROM met m LEFT JOIN spans s ON s.k = m.k
  WHERE field NOT IN {_IN(M.LABELS)} AND (len(wanted) = 1 OR len(found) >= 2) AND (NOT choosing OR m.k IN (SELECT k FROM near)) AND (NOT in_context OR list_contains(said, {AROUND.sql}))
    AND len(list_filter(found, lambda w: w NOT IN {_IN(T.GENERIC_WORDS)})) > 0 AND (field IN {_IN(M.TEACHING)} OR len(found) < 2 OR found_span <= 5) AND (len(subj) < 2 OR len(subj) = len(subjects) OR subj_span <= 8)),
fits AS (SELECT *, list_sort(list_filter(task, lambda w: list_contains(said, w))) AS hit,
    len(found) + CASE WHEN field IN {_IN(M.TITLES)} THEN 8 ELSE 0 END + CASE WHEN contains(' ' || array_to_string(words, ' ') || ' ', ' ' || phrase || ' ') THEN 5 ELSE 0 END AS strength
  FROM kept WHERE len(subjects) = 0 OR part > 0.5 OR (part = 0.5 AND list_contains(found, action))),
best AS (SELECT *, len(hit) / len(task) AS coverage, len(found) / len(wanted) AS lexical_fit FROM fits
  QUALIFY row_number() OVER (PARTITION BY course_id, requirement, place ORDER BY field IN {_IN(M.TEACHING)} DESC, len(hit) / len(task) DESC, len(found) / len(wanted) DESC, strength DESC, field DESC, passage DESC) = 1),
one AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY course_id, requirement ORDER BY coverage DESC, lexical_fit DESC, strength DESC, place) = 1),
tagged AS (SELECT course_id, requirement, place, list_sort(list_distinct(flatten(list(found)))) AS label_terms FROM met WHERE field IN {_IN(M.LABELS)} GROUP BY ALL),
context AS (SELECT DISTINCT course_id FROM heard WHERE field NOT IN {_IN(M.LABELS + M.CODES)} AND list_contains(said, {AROUND.sql})),
matched AS (SELECT o.course_id, o.requirement, o.query AS query_used, o.field, o.passage, o.hit AS matched_terms, list_sort(list_filter(o.task, lambda w: NOT list_contains(o.hit, w))) AS missing_terms, o.coverage, o.lexical_fit, o.strength,
    coalesce(t.label_terms, []) AS label_terms, c.course_id IS NULL AS context_review, o.asks_work AS work_review,
    CASE WHEN o.coverage = 0 THEN 'supporting' WHEN c.course_id IS NULL THEN 'context-review-needed' WHEN o.coverage = 1 THEN 'direct' ELSE 'partial' END AS support
  FROM one o LEFT JOIN tagged t ON t.course_id = o.course_id AND t.requirement = o.requirement AND t.place = o.place LEFT JOIN context c ON c.course_id = o.course_id)"""


def _matches(t: Tables) -> DataFrame:
    terms, context = (X.SEARCH_TERMS, X.CONTEXT) if isinstance(t, AwkwardRows) else (SEARCH_TERMS, "widget expert")
    return M.match_requirements(COURSE_FIELDS.frame(t), REQUIREMENTS.of(t), search_terms=terms, context=context)


@query("T7 F13 F15 W4", f"WITH {MATCH_SQL} SELECT course_id, requirement, query_used, field, passage, matched_terms, missing_terms, round(coverage, 6) AS coverage, round(lexical_fit, 6) AS lexical_fit, strength::INTEGER AS strength, label_terms, context_review, work_review, support FROM matched")
def requirement_matches(t: Tables) -> DataFrame:
    return _matches(t).withColumns({"coverage": F.round("coverage", 6), "lexical_fit": F.round("lexical_fit", 6)})


RANK_SQL = f"""{MATCH_SQL}, {COURSES.sql}, {REVIEWS.sql}, {SIMILARITIES.sql}, {PRIORITIES.sql}, {STRENGTH.sql},
last AS (SELECT * FROM course_reviews QUALIFY row_number() OVER (PARTITION BY course_id, requirement ORDER BY course_reviews."at" DESC) = 1),
judged AS (SELECT coalesce(m.course_id, r.course_id) AS course_id, coalesce(m.requirement, r.requirement) AS requirement, r.decision IS NOT NULL AS reviewed, r.decision,
    CASE WHEN r.decision IS NULL THEN coverage ELSE 1.0 END AS coverage, CASE WHEN r.decision IS NULL THEN strength ELSE 10 END AS strength,
    CASE WHEN r.decision IS NULL THEN context_review ELSE false END AS context_review, CASE WHEN r.decision IS NULL THEN work_review ELSE false END AS work_review,
    CASE WHEN r.decision IS NULL THEN support WHEN r.decision = 'supplemental' THEN 'supporting' ELSE 'direct' END AS support
  FROM matched m FULL JOIN last r ON m.course_id = r.course_id AND m.requirement = r.requirement WHERE r.decision IS NULL OR r.decision <> 'reject'),
usable AS (SELECT j.*, c.classified, coalesce(s.similarity, -1) AS similarity, sum(CASE WHEN j.requirement = {MUST.sql} THEN coverage ELSE 0 END) OVER (PARTITION BY j.course_id) AS delivers
  FROM judged j JOIN course_facts c ON c.course_id = j.course_id AND c.named_material LEFT JOIN similarities s ON s.course_id = j.course_id AND s.requirement = j.requirement),
keyed AS (SELECT *, coalesce(decision = 'supplemental', false) AS spare, classified <> 'reviewed' AS unsure FROM usable),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY requirement ORDER BY NOT reviewed, spare, coverage DESC, delivers DESC, strength DESC, context_review, unsure, similarity DESC) AS fit,
    row_number() OVER (PARTITION BY requirement ORDER BY NOT reviewed, spare, coverage DESC, delivers DESC, strength DESC, context_review, unsure, similarity DESC, course_id) AS was FROM keyed),
members AS (SELECT requirement, fit, count(*) AS n FROM ranked GROUP BY ALL HAVING count(*) > 1),
grp AS (SELECT r.requirement, r.fit, s.provider, s.year, s.subject, s.version FROM ranked r JOIN members m USING (requirement, fit) JOIN strength s ON s.requirement = r.requirement AND s.course_id = r.course_id
  GROUP BY ALL HAVING count(DISTINCT r.course_id) = any_value(m.n)),
pick AS (SELECT * FROM grp QUALIFY row_number() OVER (PARTITION BY requirement, fit ORDER BY CASE provider WHEN 'qs' THEN 1 WHEN 'the' THEN 2 ELSE 9 END, year DESC, provider, subject, version) = 1),
band AS (SELECT r.requirement, r.fit, r.course_id, s.low, s.high FROM ranked r JOIN pick p USING (requirement, fit) JOIN strength s ON s.requirement = r.requirement AND s.course_id = r.course_id AND s.provider = p.provider AND s.year = p.year AND s.subject = p.subject AND s.version = p.version),
mixed AS (SELECT DISTINCT a.requirement, a.fit FROM band a JOIN band b USING (requirement, fit) WHERE (a.low, a.high) <> (b.low, b.high) AND greatest(a.low, b.low) <= least(a.high, b.high)),
fine AS (SELECT band.* FROM band LEFT JOIN mixed x ON x.requirement = band.requirement AND x.fit = band.fit WHERE x.fit IS NULL),
placed AS (SELECT r.*, CASE WHEN f.low IS NULL THEN was ELSE min(was) OVER (PARTITION BY r.requirement, r.fit) - 1 + row_number() OVER (PARTITION BY r.requirement, r.fit ORDER BY f.low NULLS LAST, f.high NULLS LAST, was) END AS position
  FROM ranked r LEFT JOIN fine f ON f.requirement = r.requirement AND f.fit = r.fit AND f.course_id = r.course_id),
tiered AS (SELECT p.requirement, p.course_id, p.position, coalesce(q.priority, 'essential') AS priority,
    position = 1 AND coalesce(q.priority, 'essential') = 'essential' AND CASE WHEN reviewed THEN decision = 'essential' ELSE coverage = 1 AND NOT context_review AND NOT work_review END AS must
  FROM placed p LEFT JOIN priorities q ON q.requirement = p.requirement WHERE position <= 3)"""


def _ranked(t: Tables) -> tuple[DataFrame, DataFrame]:
    judged = M.reviewed_matches(_matches(t), REVIEWS.frame(t))
    ranked = M.rank_matches(judged, COURSES.frame(t), SIMILARITIES.frame(t), MUST.of(t))
    return judged, M.rerank_by_strength(ranked, STRENGTH.frame(t), ["qs", "the"])


@query("W2 J13 J14", f"WITH {RANK_SQL} SELECT requirement, course_id, fit::INTEGER AS fit, position::INTEGER AS position FROM placed")
def strength_reranking(t: Tables) -> DataFrame:
    return _ranked(t)[1].select("requirement", "course_id", "fit", "position")


@query("W1 W3 P1 P2 P4 P10", f"""
WITH {RANK_SQL}
SELECT requirement, course_id, position::INTEGER AS position, CASE WHEN must THEN 'must-have' ELSE 'supplemental' END AS tier,
  CASE WHEN must THEN 'primary' WHEN priority = 'essential' THEN 'alternative' ELSE 'supplemental-interest' END AS selection_kind,
  CASE WHEN bool_or(must) OVER (PARTITION BY course_id) THEN 'must-have' ELSE 'supplemental' END AS role FROM tiered""")
def course_selection(t: Tables) -> DataFrame:
    return M.select_courses(_ranked(t)[1], 3, PRIORITIES.frame(t))


@query("A13 P1", f"""
WITH {RANK_SQL}, chosen AS (SELECT DISTINCT course_id FROM tiered), asks AS (SELECT unnest([{REQUIREMENTS.sql}]) AS requirement),
links AS (SELECT u.requirement, count(*) AS n, bool_or(coverage = 1 AND NOT context_review AND NOT work_review AND support <> 'supporting' AND coalesce(decision <> 'supplemental', true)) AS sure, bool_and(context_review) AS pending
  FROM usable u JOIN chosen USING (course_id) GROUP BY u.requirement)
SELECT a.requirement, CASE WHEN sure THEN 'candidate-match' WHEN n > 0 THEN 'partial-candidate-match' ELSE 'uncovered' END AS status, coalesce(n, 0) AS n_links,
  CASE WHEN sure THEN NULL WHEN pending THEN 'task-context-review' WHEN n > 0 THEN 'partial-task-fit' ELSE 'missing-task-evidence' END AS gap_kind
FROM asks a LEFT JOIN links l ON l.requirement = a.requirement""")
def selection_coverage(t: Tables) -> DataFrame:
    judged, ranked = _ranked(t)
    chosen = M.select_courses(ranked, 3, PRIORITIES.frame(t)).select("course_id").distinct()
    asked = t.spark.createDataFrame([(r,) for r in REQUIREMENTS.of(t)], "requirement string")
    return M.coverage_of(asked, ranked.join(chosen, "course_id", "left_semi"))


@query("A14", f"""
WITH {MATERIALS.sql}, m AS (
  SELECT *, lower(coalesce(reading_role, 'not_stated')) AS r, coalesce(verified, false) AND edition <> '' AND authors <> '' AS exact FROM materials
), p AS (
  SELECT *, CASE WHEN r SIMILAR TO '.*(optional|recommended|suggested|supplemental|supplementary).*' THEN 'supplemental' WHEN r SIMILAR TO '.*(required|assigned|primary).*' AND NOT contains(r, 'not') THEN course_role ELSE 'review-needed' END AS priority FROM m
)
SELECT any_value(key) AS key, any_value(exact) AS exact, CASE WHEN bool_or(priority = 'must-have') THEN 'must-have' WHEN bool_or(priority = 'review-needed') THEN 'review-needed' ELSE 'supplemental' END AS priority, list_sort(list(course_id)) AS assignments
FROM p GROUP BY key, lower(title), lower(authors), lower(edition), CASE WHEN exact THEN '' ELSE course_id || source_key || line END""")
def acquisition_merge(t: Tables) -> DataFrame:
    return M.acquisitions(MATERIALS.frame(t))


_FOR = Words(("the blue gizmo and thre analysis",), ("the control of structures and robotics analysis",))
_FOR_WORDS = Words(("blue", "gizmo", "thre", "analysis"), ("control", "structure", "robot", "analysis"))
_FOR_PHRASE = Words((" blue gizmo thre analysis ",), (" control structure robot analysis ",))


@query("T4 T5", f"""
WITH {COURSE_FIELDS.sql}, w AS (SELECT course_id, field, list_filter(list_transform(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda w: coalesce(({_FORMS})[w], w)), lambda w: w NOT IN {_IN(T.PLAN_STOP_WORDS)}) AS words FROM course_fields),
f AS (SELECT *, list_filter([{_FOR_WORDS.sql}], lambda x: list_contains(words, x)) AS found, CASE WHEN field IN {_IN(retrieval.SOURCE_FIELDS)} THEN 's' WHEN field IN {_IN(retrieval.FACET_FIELDS)} THEN 'f' ELSE 'o' END AS kind FROM w),
h AS (SELECT * FROM f WHERE len(found) > 0), df AS (SELECT x, count(DISTINCT course_id) AS df FROM (SELECT course_id, unnest(found) AS x FROM h) GROUP BY x), n AS (SELECT count(DISTINCT course_id) AS n FROM course_fields),
rare AS (SELECT course_id, round(sum(CASE WHEN x = 'analysis' THEN 0 ELSE ln(1 + n / (1 + df)) END), 9) AS specificity FROM (SELECT DISTINCT course_id, unnest(found) AS x FROM h WHERE kind = 's') JOIN df USING (x), n GROUP BY course_id),
p AS (SELECT course_id, len(list_distinct(flatten(list(found) FILTER (WHERE kind = 's')))) AS source_terms, max(len(found)) FILTER (WHERE kind = 's') AS field_terms, max((contains(' ' || array_to_string(words, ' ') || ' ', {_FOR_PHRASE.sql}))::INT) FILTER (WHERE kind = 's') AS phrase,
  max(len(found)) FILTER (WHERE field IN ('title', 'course_title')) AS title_terms, len(list_distinct(flatten(list(found) FILTER (WHERE kind = 'o')))) AS official_terms, len(list_distinct(flatten(list(found) FILTER (WHERE kind = 'f')))) AS facet_terms FROM h GROUP BY course_id),
z AS (SELECT course_id, coalesce(specificity, 0) AS specificity, coalesce(source_terms, 0) AS source_terms, coalesce(field_terms, 0) AS field_terms, coalesce(phrase, 0) AS phrase, coalesce(title_terms, 0) AS title_terms, coalesce(official_terms, 0) AS official_terms, coalesce(facet_terms, 0) AS facet_terms FROM p LEFT JOIN rare USING (course_id))
SELECT *, row_number() OVER (ORDER BY specificity DESC, source_terms DESC, field_terms DESC, phrase DESC, title_terms DESC, official_terms DESC, facet_terms DESC, course_id) AS place FROM z""")
def catalog_discovery(t: Tables) -> DataFrame:
    return retrieval.discover(COURSE_FIELDS.frame(t), *_FOR.of(t))
