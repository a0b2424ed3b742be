"""The rule engine, overlays and facets, over courses read from the given tables; tests run them on awkward courses too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules as R
from ..registry import query
from ..session import Tables
from .bound import Bound
from .fixtures import Fixture, sql_value

TERMS = Bound(
    Fixture(
    "terms",
    "area string, phrase string, topic boolean",
    (
        ("engineering", "mechanical engineering", False), ("engineering", "engineering", False), ("engineering", "robotics", True), ("engineering", "control systems", True), ("computing", "computer science", False), ("computing", "robotics", True), ("computing", "machine learning", True),
        ("computing", "learning", True), ("history", "history", False), ("history", "medieval history", True), ("history", "history", True), ("health-medicine", "medicine", False), ("health-medicine", "anatomy", True), ("health-medicine", "nutrition", True), ("health-medicine", "public health", True),
        ("biology", "anatomy", True), ("biology", "biology", False), ("interdisciplinary-general", "general studies", False), ("interdisciplinary-general", "seminar", True),
    ),
),
    """
    SELECT CASE p_size % 6 WHEN 0 THEN 'engineering' WHEN 1 THEN 'computing' WHEN 2 THEN 'history' WHEN 3 THEN 'health-medicine' WHEN 4 THEN 'biology' ELSE 'interdisciplinary-general' END AS area,
      p_name AS phrase, p_partkey % 2 = 0 AS topic FROM {part} WHERE p_partkey % 3 = 0
    UNION SELECT CASE length(p_type) % 3 WHEN 0 THEN 'engineering' WHEN 1 THEN 'computing' ELSE 'history' END, lower(p_type), false FROM {part}
    UNION SELECT CASE item_id % 4 WHEN 0 THEN 'biology' WHEN 1 THEN 'history' WHEN 2 THEN 'computing' ELSE 'interdisciplinary-general' END, concat_ws(' ', split_part(lower(text), ' ', 2), split_part(lower(text), ' ', 3)), true FROM {benchmark}""",
)

FIELDS = Bound(
    Fixture(
    "fields",
    "course_key string, basis string, field string, text string",
    (
        ("a", "official_department", "official_department_labels", "Mechanical Engineering"), ("a", "course_title_or_subject_code", "title", "Robotics and Control Systems"), ("a", "course_description", "description", "History of machine learning."),
        ("b", "official_department", "official_department_labels", "Computer Science & Engineering"), ("b", "course_title_or_subject_code", "title", "Machine-Learning"), ("c", "official_department", "official_department_labels", "Engineering"), ("c", "official_department", "official_department_labels", "History"),
        ("c", "course_title_or_subject_code", "title", "Topics"), ("d", "course_title_or_subject_code", "title", "Robotics"), ("e", "course_description", "description", "A medieval history of public health; nutrition in animal husbandry"), ("f", "course_title_or_subject_code", "title", "Animal anatomy"),
        ("g", "course_title_or_subject_code", "title", "Anatomy"), ("g", "course_description", "description", "Plant anatomy too"), ("h", "course_title_or_subject_code", "title", "Nothing known"), ("i", "course_title_or_subject_code", "title", "First seminar"), ("j", "course_title_or_subject_code", "title", "Seminar in robotics"),
        ("j", "course_title_or_subject_code", "code", "history 1"), ("k", "official_school", "official_school_labels", "School of Medicine and Biology"), ("l", "official_department", "official_department_labels", "History"), ("m", "course_title_or_subject_code", "title", "Prehistory, unlearning"), ("n", "course_title_or_subject_code", "title", ""),
        ("o", "official_department", "official_department_labels", "History"), ("o", "official_department", "official_department_labels", "Computer science"), ("o", "course_title_or_subject_code", "title", "Medieval History and Learning"),
    ),
),
    """
    SELECT concat('p', CAST(p_partkey AS STRING)) AS course_key, 'official_department' AS basis, 'official_department_labels' AS field, p_type AS text FROM {part} WHERE p_partkey % 3 <> 1
    UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 'course_title_or_subject_code', 'title', concat(p_name, ', ', CASE WHEN p_size % 9 = 0 THEN 'animal ' ELSE '' END, p_brand) FROM {part}
    UNION ALL SELECT concat('p', CAST(l_partkey AS STRING)), 'course_description', 'description', concat('With a ', p_name, '.') FROM {lineitem} JOIN {part} ON p_partkey = l_suppkey * 7 WHERE l_linenumber = 1
    UNION ALL SELECT concat('d', CAST(doc_id AS STRING)), 'course_description', 'description', text FROM {documents}
    UNION ALL SELECT concat('d', CAST(doc_id AS STRING)), 'course_title_or_subject_code', 'title', split_part(text, '.', 1) FROM {documents}""",
)

FACTS = Bound(
    Fixture(
    "facts",
    "course_key string, parse_review boolean, bookstore_only boolean",
    tuple((k, k in "eh", k == "l") for k in "abcdefghijklmno"),
),
    """
    SELECT concat('p', CAST(p_partkey AS STRING)) AS course_key, p_size % 7 = 0 AS parse_review, p_size % 11 = 0 AS bookstore_only FROM {part}
    UNION ALL SELECT concat('d', CAST(doc_id AS STRING)), n_chars % 5 = 0, false FROM {documents}""",
)

_PLAIN = "array_to_string(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), ' ')"
_EVIDENCE = rf"""
{TERMS.sql}, {FIELDS.sql}, {FACTS.sql}, said AS (SELECT *, ' ' || {_PLAIN} || ' ' AS p, basis IN ('course_title_or_subject_code', 'course_description') AS topical,
  CASE basis WHEN 'official_department' THEN 4 WHEN 'official_school' THEN 2 WHEN 'course_title_or_subject_code' THEN 3 ELSE 1 END AS tier FROM fields),
spelled AS (SELECT DISTINCT area, array_to_string(regexp_extract_all(lower(phrase), '[\pL\pN_]+'), ' ') AS phrase, topic FROM terms),
beasts AS (SELECT course_key, basis FROM said WHERE regexp_matches(p, '\b(?:animal|plant|insect|veterinary)\b') GROUP BY ALL),
evidence AS (SELECT DISTINCT s.course_key, area, s.basis, tier, field, phrase, len(string_split(phrase, ' ')) AS n_words FROM said s JOIN spelled ON topic = topical AND contains(p, ' ' || phrase || ' ') LEFT JOIN beasts b ON b.course_key = s.course_key AND b.basis = s.basis
  WHERE NOT (b.basis IS NOT NULL AND topical AND area = 'health-medicine' AND phrase IN ('physiology', 'pathology', 'anatomy', 'nutrition')))"""


def _evidence(t: Tables) -> DataFrame:
    return R.phrase_evidence(FIELDS.frame(t), TERMS.frame(t))


@query("R1 R4 R15", f"WITH {_EVIDENCE} SELECT course_key, area, basis, tier, field, phrase, n_words::INTEGER AS n_words FROM evidence")
def phrase_evidence(t: Tables) -> DataFrame:
    return _evidence(t)


@query("R1 R2", f"""
WITH {_EVIDENCE}, s AS (SELECT course_key, area, max(tier * 100 + n_words) AS strength, max(tier) AS tier, arg_max(basis, tier * 100 + n_words) AS basis, coalesce(max(n_words) FILTER (WHERE field IN ('title', 'course_title')), 0) AS topic FROM evidence JOIN facts USING (course_key) WHERE NOT bookstore_only GROUP BY ALL),
real AS (SELECT * FROM s WHERE area <> 'interdisciplinary-general' OR course_key NOT IN (SELECT course_key FROM s WHERE area <> 'interdisciplinary-general')),
top AS (SELECT *, count(*) OVER w AS n, max(topic) OVER w AS best, max(strength) OVER w AS longest FROM (SELECT *, max(tier) OVER (PARTITION BY course_key) AS most FROM real) WHERE tier = most WINDOW w AS (PARTITION BY course_key)),
pick AS (SELECT *, most >= 4 AND n > 1 AND best > 0 AS by_topic FROM top WHERE CASE WHEN most >= 4 AND n > 1 AND best > 0 THEN topic = best ELSE strength = longest END),
g AS (SELECT course_key, list_sort(list(area)) AS found, CASE WHEN any_value(by_topic) THEN 'specific-course-topic-within-department' ELSE arg_min(basis, area) END AS basis, any_value(most) AS most FROM pick GROUP BY course_key)
SELECT f.course_key, CASE WHEN len(found) = 1 THEN found[1] ELSE 'other-academic-subject' END AS primary, coalesce(found, ['other-academic-subject']) AS candidates, coalesce(basis, 'unresolved-source-evidence') AS basis,
  list_filter([CASE WHEN found IS NULL THEN CASE WHEN bookstore_only THEN 'bookstore-identity-unverified' ELSE 'unmapped-area' END END, CASE WHEN parse_review THEN 'source-parse-needs-review' END, CASE WHEN len(found) > 1 THEN 'conflicting-primary-areas' END, CASE WHEN most = 1 THEN 'description-only-area' END], lambda x: x IS NOT NULL) AS reasons
FROM facts f LEFT JOIN g USING (course_key)""")
def primary_area(t: Tables) -> DataFrame:
    return R.primary_areas(FACTS.frame(t), R.area_strengths(_evidence(t)))


_CODES = Bound(
    Fixture("codes", "code string, subject_code string", (("6.003", None), ("21W.735", ""), ("CS61A", None), ("HIST 101", "HIST"), ("hist-101", None), ("101", None), ("_x", None), (None, "AFAM "), (None, None), ("EN.601", None), ("Écon 1", None))),
    """
    SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN concat(CAST(p_size AS STRING), '.', CAST(p_partkey AS STRING)) WHEN 1 THEN concat(p_type, ' ', CAST(p_size AS STRING)) WHEN 2 THEN concat(CAST(p_size AS STRING), 'W.7') WHEN 3 THEN concat(lower(p_type), '-', CAST(p_size AS STRING)) WHEN 4 THEN CAST(p_partkey AS STRING) ELSE concat('CS', CAST(p_size AS STRING), 'A') END AS code,
      CASE p_size % 5 WHEN 0 THEN p_brand WHEN 1 THEN '' END AS subject_code FROM {part}""",
)


@query("R3", rf"""
WITH {_CODES.sql}, k AS (SELECT *, CASE WHEN subject_code <> '' THEN subject_code ELSE regexp_extract(coalesce(code, ''), '^(\d+[A-Za-z]*|[A-Za-z]+)(?:[.\s\d-]|$)', 1) END AS said FROM codes)
SELECT code, subject_code, array_to_string(regexp_extract_all(lower(said), '[\pL\pN_]+'), ' ') AS prefix FROM k""")
def prefix_context(t: Tables) -> DataFrame:
    return _CODES.frame(t).select("code", "subject_code", R.context_prefix(F.col("code"), F.col("subject_code")).alias("prefix"))


_RULES = Bound(
    Fixture(
    "rules",
    "course_key string, rule_primary string, resolved boolean, candidates array<string>, tier int, reasons array<string>, warned boolean",
    (
        ("a", "history", True, ["history"], 4, [], False), ("b", "history", True, ["history"], 3, ["description-only-area"], False), ("c", "history", True, ["history"], 1, ["source-parse-needs-review"], False), ("d", "history", True, ["history", "law"], 4, ["conflicting-primary-areas"], False),
        ("e", "other-academic-subject", False, ["other-academic-subject"], 0, ["unmapped-area"], True), ("f", "law", True, ["law"], 4, [], True), ("g", "law", True, ["law"], 4, [], False), ("h", "law", False, ["law"], 4, [], False), ("i", "law", True, ["law"], 3, ["conflicting-source-classifications"], False), ("j", "", True, [""], 3, None, False),
    ),
),
    """
    SELECT CAST(o_orderkey AS STRING) AS course_key, CASE o_custkey % 5 WHEN 0 THEN 'history' WHEN 1 THEN 'law' WHEN 2 THEN 'other-academic-subject' WHEN 3 THEN '' ELSE 'history' END AS rule_primary, o_orderkey % 4 <> 0 AS resolved,
      split(CASE o_custkey % 5 WHEN 0 THEN 'history' WHEN 1 THEN 'law' WHEN 2 THEN 'other-academic-subject' WHEN 3 THEN '' ELSE 'history,law' END, ',') AS candidates, o_orderkey % 5 AS tier,
      CASE o_custkey % 7 WHEN 0 THEN split('unmapped-area', ',') WHEN 1 THEN split('source-parse-needs-review,description-only-area', ',') WHEN 2 THEN split('conflicting-primary-areas', ',') WHEN 3 THEN split('conflicting-source-classifications', ',') END AS reasons, o_orderstatus = 'P' AS warned
    FROM {orders}""",
)
_ANSWERS = Bound(
    Fixture(
    "answers",
    "course_key string, answer string, status string, why array<string>",
    (
        ("a", "history", "candidate", []), ("b", "law", "candidate", []), ("c", "other-academic-subject", "needs-review", ["low-model-confidence"]), ("d", "other-academic-subject", "needs-review", ["low-model-confidence"]), ("e", "law", "candidate", None), ("f", None, "invalid", []),
        ("g", "other-academic-subject", "needs-review", ["insufficient-subject-evidence"]), ("j", "law", "candidate", []),
    ),
),
    """
    SELECT CAST(o_orderkey AS STRING) AS course_key, CASE WHEN o_custkey % 11 <> 4 THEN CASE o_totalprice > 200000 WHEN true THEN 'history' ELSE CASE o_custkey % 3 WHEN 0 THEN 'law' ELSE 'other-academic-subject' END END END AS answer,
      CASE o_custkey % 11 WHEN 4 THEN 'invalid' WHEN 5 THEN 'needs-review' WHEN 6 THEN 'needs-review' ELSE 'candidate' END AS status, CASE o_custkey % 11 WHEN 5 THEN split('low-model-confidence', ',') WHEN 6 THEN split('insufficient-subject-evidence,unmapped-area', ',') END AS why
    FROM {orders} WHERE o_orderkey % 3 <> 0""",
)
_AGAIN = Bound(
    Fixture("again", "course_key string, answer string, status string, why array<string>", (("d", "law", "candidate", []), ("g", "other-academic-subject", "needs-review", ["choice-distribution-conflict"]), ("b", "history", "candidate", []))),
    """
    SELECT CAST(o_orderkey AS STRING) AS course_key, CASE o_custkey % 3 WHEN 0 THEN 'law' WHEN 1 THEN 'history' ELSE 'other-academic-subject' END AS answer, CASE o_custkey % 2 WHEN 0 THEN 'candidate' ELSE 'needs-review' END AS status,
      CASE o_custkey % 4 WHEN 1 THEN split('choice-distribution-conflict', ',') END AS why FROM {orders} WHERE o_orderkey % 5 = 1 AND o_orderkey % 3 <> 0""",
)


@query("R7 R10", f"""
WITH {_RULES.sql}, {_ANSWERS.sql}, {_AGAIN.sql},
j AS (SELECT r.*, a.answer AS a1, a.status AS s1, a.why AS w1, g.answer AS a2, g.status AS s2, g.why AS w2, rule_primary NOT IN ('', '{R.UNRESOLVED}') AS telling FROM rules r LEFT JOIN answers a ON a.course_key = r.course_key LEFT JOIN again g ON g.course_key = r.course_key),
first AS (SELECT course_key, unnest(reasons) AS x, true AS ruled FROM j UNION ALL
  SELECT course_key, unnest(CASE WHEN s1 IS NULL THEN ['jev-classification-not-completed'] WHEN s1 = 'invalid' THEN ['jev-invalid-answer'] WHEN s1 <> 'candidate' THEN ['jev-subject-needs-review'] || coalesce(w1, []) WHEN telling AND a1 <> rule_primary THEN ['jev-rule-field-disagreement'] ELSE [] END), false FROM j),
last AS (SELECT f.course_key, x FROM first f JOIN j USING (course_key) WHERE NOT (ruled AND x IN {R.OF_FIELDS}) AND NOT (s2 IS NOT NULL AND x IN {R.CLEARED}) UNION
  SELECT course_key, unnest(CASE WHEN s2 <> 'candidate' THEN ['jev-subject-needs-review'] || coalesce(w2, []) WHEN s2 = 'candidate' AND telling AND a2 <> rule_primary THEN ['jev-rule-field-disagreement'] ELSE [] END) FROM j UNION
  SELECT course_key, 'bookstore-identity-unverified' FROM j WHERE warned),
g AS (SELECT j.course_key, rule_primary, CASE WHEN s2 IS NOT NULL THEN a2 WHEN s1 IN ('candidate', 'needs-review') THEN a1 ELSE '{R.UNRESOLVED}' END AS given,
    resolved AND candidates = [rule_primary] AND telling AND tier >= 3 AND NOT list_has_any(coalesce(reasons, []), {list(R.UNSOUND)}) AS strong, coalesce((SELECT list_sort(list(x)) FROM last WHERE last.course_key = j.course_key), []) AS reasons FROM j),
m AS (SELECT *, given = '{R.UNRESOLVED}' AND strong AS fall FROM g), n AS (SELECT *, CASE WHEN fall THEN rule_primary ELSE given END AS "primary" FROM m)
SELECT course_key, "primary", CASE WHEN fall THEN 'source-grounded-rules-fallback-after-jev-review' ELSE 'jev-source-metadata-candidate' END AS method, reasons,
  CASE WHEN len(reasons) > 0 OR "primary" = '{R.UNRESOLVED}' THEN 'needs-review' ELSE 'candidate' END AS status, CASE WHEN "primary" = '{R.UNRESOLVED}' THEN 'unresolved' WHEN fall THEN 'source-grounded-model-review' ELSE 'model-candidate' END AS resolution FROM n""")
def review_overlay(t: Tables) -> DataFrame:
    return R.overlaid(_RULES.frame(t), _ANSWERS.frame(t), _AGAIN.frame(t))


_LAYERS = Bound(
    Fixture(
    "layers",
    "layer int, course_key string, area string, fields array<string>",
    (
        (0, "a", "history", ["title"]), (1, "a", "law", ["school"]), (2, "a", "history", ["code"]), (2, "a", "art", []), (1, "b", "law", ["school", "code"]), (2, "b", "art", ["reading"]), (0, "c", "art", ["code"]), (1, "c", "art", ["description", "code"]), (2, "c", "law", ["departments"]), (2, "c", "music", ["departments", "reading"]),
    ),
),
    """
    SELECT CAST(l_linenumber % 3 AS INT) AS layer, CAST(l_orderkey AS STRING) AS course_key, p_type AS area,
      split(CASE l_suppkey % 7 WHEN 0 THEN 'title' WHEN 1 THEN 'school' WHEN 2 THEN 'code' WHEN 3 THEN 'departments,reading' WHEN 4 THEN 'school,code' WHEN 5 THEN 'description,code' ELSE 'departments' END, ',') AS fields
    FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
)
_NAMES = ("rules", "model", "literal")


@query("R8 R11 R13", f"""
WITH {_LAYERS.sql}, u AS (SELECT course_key, area, {sql_value(_NAMES)}[min(layer) + 1] AS basis, list_sort(list_distinct(flatten(list(fields)))) AS fields FROM layers GROUP BY course_key, area),
k AS (SELECT *, list_has_any(fields, {sql_value(R.SPECIFIC_FIELDS)}) AS about, len(fields) > 0 AND list_has_all({sql_value(R.AFFILIATION_FIELDS)}, fields) AS alone FROM u)
SELECT course_key, area, basis, fields FROM k WHERE about OR NOT alone OR course_key NOT IN (SELECT course_key FROM k WHERE about)""")
def facet_union(t: Tables) -> DataFrame:
    rows = _LAYERS.frame(t)
    return R.facet_union([(rows.where(F.col("layer") == i), n) for i, n in enumerate(_NAMES)])


_SUPPORT = Bound(
    Fixture(
    "support",
    "facet string, course double, reading double, choice string, none_p double, unknown_p double, lexical boolean",
    (
        ("a", 0.99, 0.1, "x1", 0.01, 0.01, False), ("b", 0.99, 0.97, "x2", 0.0, 0.0, False), ("c", 0.2, 0.96, "x1", 0.0, 0.0, False), ("d", 0.2, 0.3, "none", 0.9, 0.1, False), ("e", 0.96, 0.1, "x1", 0.04, 0.02, False), ("f", 0.96, 0.1, "none", 0.9, 0.1, True), ("g", None, 0.99, "x2", 0.0, 0.0, False),
        ("h", None, 0.5, "x2", 0.0, 0.0, False), ("i", 0.95, 0.1, "x1", 0.05, 0.0, False), ("j", 0.1, 0.99, "x2", 0.0, 0.0, False),
    ),
),
    """
    SELECT CAST(o_orderkey AS STRING) AS facet, CASE WHEN o_orderkey % 13 <> 0 THEN (90 + o_custkey % 11) / 100.0 END AS course, CASE WHEN o_orderkey % 17 <> 0 THEN (90 + o_orderkey % 11) / 100.0 END AS reading,
      CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'unknown' ELSE concat('x', CAST(o_custkey % 3 + 1 AS STRING)) END AS choice, (o_custkey % 5) / 100.0 AS none_p, (o_orderkey % 3) / 100.0 AS unknown_p, o_orderpriority = '1-URGENT' AS lexical FROM {orders}""",
)
_ANCHORS = Bound(
    Fixture(
    "anchors",
    "facet string, anchor string, kind string, p double",
    (("a", "x1", "course", 0.97), ("a", "x2", "reading", 0.01), ("b", "x1", "course", 0.5), ("b", "x2", "reading", 0.5), ("c", "x1", "course", 0.98), ("c", "x2", "reading", 0.02), ("e", "x1", "course", 0.94), ("f", "x1", "course", 0.0), ("g", "x2", "reading", 1.0), ("h", "x2", "reading", 1.0), ("i", "x1", "course", 0.95), ("j", "x1", "reading", 0.5), ("j", "x2", "reading", 0.5)),
),
    """
    SELECT CAST(l_orderkey AS STRING) AS facet, concat('x', CAST(l_linenumber AS STRING)) AS anchor, CASE WHEN min(l_suppkey) % 2 = 0 THEN 'course' ELSE 'reading' END AS kind, (40 + min(l_partkey) % 60) / 100.0 AS p
    FROM {lineitem} WHERE l_linenumber <= 3 GROUP BY l_orderkey, l_linenumber""",
)


@query("R9 R12", f"""
WITH {_SUPPORT.sql}, {_ANCHORS.sql}, k AS (SELECT *, list_filter([CASE WHEN course >= 0.95 THEN 'course' END, CASE WHEN reading >= 0.95 THEN 'reading' END], lambda x: x IS NOT NULL) AS kinds FROM support),
m AS (SELECT k.*, coalesce((SELECT sum(p) FROM anchors a WHERE a.facet = k.facet AND list_contains(k.kinds, a.kind)), 0) AS mass, (SELECT max(kind) FROM anchors a WHERE a.facet = k.facet AND a.anchor = k.choice) AS ck FROM k),
r AS (SELECT *, list_filter([CASE WHEN len(kinds) = 0 THEN 'insufficient-subject-evidence' END, CASE WHEN choice NOT IN ('none', 'unknown') AND NOT coalesce(list_contains(kinds, ck), false) AND NOT lexical THEN 'support-anchor-basis-conflict' END,
  CASE WHEN (round(mass, 9) < 0.95 OR round(none_p + unknown_p, 9) > 0.05) AND NOT lexical THEN 'insufficient-anchor-support' END], lambda x: x IS NOT NULL) AS reasons FROM m)
SELECT facet, CASE WHEN len(reasons) = 0 THEN 'candidate' WHEN course IS NULL OR reading IS NULL THEN 'invalid-answer' ELSE 'needs-review' END AS status,
  CASE WHEN len(reasons) = 0 THEN CASE WHEN kinds = ['reading'] THEN 'reading-context-candidate' WHEN kinds = ['course'] THEN 'course-metadata-candidate' ELSE 'course-and-reading-context-candidate' END END AS basis, round(mass, 6) AS mass, reasons FROM r""")
def facet_decisions(t: Tables) -> DataFrame:
    return R.facet_decisions(_SUPPORT.frame(t), _ANCHORS.frame(t))


_BOUND = Bound(
    Fixture("bound", "course_key string, dataset_order int, source_fp string, rules_fp string", (("a", 2, "s2", "r2"), ("a", 0, "s0", "r0"), ("a", 1, "s0", None), ("b", 0, "s9", "r9"), ("c", 0, None, "r1"), ("c", 1, "s1", "r1"))),
    """
    SELECT CAST(l_orderkey AS STRING) AS course_key, l_linenumber AS dataset_order, min(CASE WHEN l_returnflag <> 'R' THEN md5(CAST(l_partkey AS STRING)) END) AS source_fp, max(CASE WHEN l_linestatus = 'O' THEN md5(CAST(l_suppkey AS STRING)) END) AS rules_fp
    FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
)


@query("R5", f"""
WITH {_BOUND.sql}, j AS (SELECT course_key, string_agg(coalesce(source_fp, '') || '|' || coalesce(rules_fp, ''), chr(10) ORDER BY dataset_order) AS text, count(*) AS n, any_value(source_fp) AS s, any_value(rules_fp) AS r FROM bound GROUP BY course_key)
SELECT course_key, n AS datasets, CASE WHEN n = 1 THEN s ELSE sha256(text) END AS source_fingerprint FROM j""")
def merged_fingerprints(t: Tables) -> DataFrame:
    """A course of several datasets is bound to what each said of it, in their order; one of a single dataset keeps its fingerprint."""
    pair = F.concat_ws("|", F.coalesce("source_fp", F.lit("")), F.coalesce("rules_fp", F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dataset_order", pair.alias("p")))), lambda x: x["p"]), "\n")
    grouped = _BOUND.frame(t).groupBy("course_key").agg(F.count("*").alias("datasets"), F.first("source_fp").alias("s"), joined.alias("text"))
    return grouped.select("course_key", "datasets", F.when(F.col("datasets") == 1, F.col("s")).otherwise(F.sha2("text", 256)).alias("source_fingerprint"))
