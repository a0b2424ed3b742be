"""Identity rules held against cases: each row of a case table has the inputs of a rule and what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import identities as N
from ..operators.block_codec import block_faults, encoded_rows
from ..registry import query
from ..session import Tables
from .bound import Bound
from .fixtures import Fixture, sql_value
from .ledger_queries import _plain as _plain_text


#: Inputs of rules over the given tables, and what must come out for the awkward cases that their tests run.
BOUND: dict[str, Bound] = {}
WANTED: dict[str, Fixture] = {}


def rule(name: str, covers: str, inputs: str, out: str, cases: list[tuple], make: Callable[[], dict[str, Column]], select: str = "", sql: str = "") -> None:
    """Register ``name``: the columns ``make`` gives over the rows of ``select``; ``sql`` says the same of them.

    The cases are tests: each has inputs and what must come out. A rule without ``select`` runs on its cases alone.
    """
    n = len(inputs.split(", "))
    given = Fixture(name, f"case_no int, {inputs}", tuple((i, *c[:n]) for i, c in enumerate(cases)))
    wanted = Fixture("wanted", f"case_no int, {out}", tuple((i, *c[n:]) for i, c in enumerate(cases)))
    rows = BOUND[name] = Bound(given, select)
    WANTED[name] = wanted

    def run(t: Tables) -> DataFrame:
        return (rows if select else given).frame(t.spark if not select else t).select("case_no", *[c.alias(k) for k, c in make().items()])

    run.__name__ = name
    query(covers, f"WITH {rows.sql} SELECT case_no, {sql} FROM {name}" if select else f"WITH {wanted.sql} SELECT * FROM wanted")(run)


def _words(x: str) -> str:
    return f"regexp_extract_all({_plain_text(x)}, '[\\pL\\pN_]+')"


def _plain(x: str) -> str:
    return f"array_to_string({_words(x)}, ' ')"


c = F.col
_YEAR = "(?:19|20)[0-9][0-9]"
_YEARS = f"list_sort(list_distinct(regexp_extract_all(version, '\\b{_YEAR}\\b') || list_transform(regexp_extract_all(version, '\\b{_YEAR}-[0-9][0-9]\\b'), lambda r: r[1:2] || r[6:7])))"
_NAMED = f"regexp_extract_all(quoted, '\\b{_YEAR}\\b')"


def _terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '\\b(?:fall|spring|summer|winter|autumn)\\s+{_YEAR}\\b')"


_EDITION = f"trim(regexp_replace({_plain('said')}, '\\b(edition|ed)\\b', '', 'g'))"

rule(
    "edition_identity", "E7", "said string", "edition string",
    [("2nd edition", "2"), ("Second Ed.", "2"), ("  twelfth   edition", "12"), ("3rd", "3"), ("10", "10"), ("Revised edition", "revised"), ("1st rev. ed", "1st rev"), ("", ""), (None, ""), ("thirteenth edition", "thirteenth"), ("<i>Fourth</i> ed", "4"), ("Édition 5", "édition 5"), ("22th", "22")],
    lambda: {"edition": N.edition(c("said"))},
    """SELECT CAST(p_partkey AS INT) AS case_no, CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(CAST(p_size AS STRING), 'th Edition') WHEN 2 THEN ' Second   Ed.' WHEN 3 THEN concat('<b>', p_type, '</b> edition &amp; ', p_brand) WHEN 4 THEN 'Twelfth ed'
      WHEN 5 THEN concat(p_name, ', ed. ', CAST(p_size AS STRING)) END AS said FROM {part} UNION ALL SELECT CAST(-1 - doc_id AS INT), concat(lang, ' ', text) FROM {documents}""",
    f"""CASE WHEN regexp_full_match({_EDITION}, '[0-9]+(st|nd|rd|th)?') THEN regexp_extract({_EDITION}, '^[0-9]+') ELSE coalesce(list_extract({[str(i) for i in range(1, 13)]}, nullif(list_position({list(N.ORDINALS)}, {_EDITION}), 0)), {_EDITION}) END AS edition""",
)

rule(
    "author_surnames", "E8", "authors string", "surnames array<string>",
    [
        ("Oppenheim, Willsky and Nawab", ["nawab", "oppenheim", "willsky"]), ("Alan V. Oppenheim; Alan S. Willsky", ["oppenheim", "willsky"]), ("Ann Lee & Bo Li / Cy Day", ["day", "lee", "li"]), ("Sandberg", ["sandberg"]), ("J. K. Rowling et al.", ["rowling"]),
        ("Smith Jr", ["smith"]), ("Lee (editors)", ["lee"]), ("", []), (None, []), ("X; Y", []), ("García Márquez, G.", ["márquez"]), ("Lee and Lee", ["lee"]),
    ],
    lambda: {"surnames": N.surnames(c("authors"))},
    """SELECT CAST(p_partkey AS INT) AS case_no, CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' and ', p_brand, '; ', p_type, ' Jr') WHEN 1 THEN concat(p_type, ', ', p_name, ' et al.') WHEN 2 THEN concat('J. ', p_name, ' &amp; K. ', p_type) WHEN 3 THEN concat(p_name, ' / ', p_name, ' (editors)') WHEN 4 THEN p_type END AS authors FROM {part}""",
    f"""list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(authors, ''), '(?i)[,;&/]|\\band\\b'), lambda p: list_filter({_words('p')}, lambda w: length(w) > 1 AND w NOT IN ('et', 'al', 'jr', 'editor', 'editors'))[-1]), lambda v: v IS NOT NULL))) AS surnames""",
)

rule(
    "contributor_match", "E8", "assigned array<string>, returned array<string>", "same boolean",
    [
        (["Alan Oppenheim"], ["A. Oppenheim"], True), (["Oppenheim, Alan V."], ["Alan V Oppenheim"], True), (["Oppenheim, A. V."], ["Alan Victor Oppenheim"], True), (["Alan Oppenheim"], ["Bob Oppenheim"], False), (["Oppenheim"], ["Alan Oppenheim"], False),
        (["oppenheim"], ["OPPENHEIM"], True), (["Alan V. Oppenheim"], ["Alan Oppenheim"], False), ([""], [""], False), ([], ["A"], False), (["X Y", "Ann Lee"], ["Bo", "Ann  Lee"], True), (["van Gogh, Vincent"], ["Vincent van Gogh"], True), (["Vincent van Gogh"], ["V. van Gogh"], True), (["Vincent van Gogh"], ["Vincent Gogh"], False), (["Lee, Ann"], ["Lee"], False),
    ],
    lambda: {"same": N.same_person(c("assigned"), c("returned"))},
)

rule(
    "display_title", "E9", "title string, authors string, isbn string, origin string", "shown string",
    [
        ("Signals / Ann Lee / ISBN 0-306-40615-2", "ann  LEE", "9780306406157", "course-citation", "Signals"), ("Signals / Ann Lee / ISBN 9780306406157", "Bo Li", "9780306406157", "course-citation", "Signals / Ann Lee / ISBN 9780306406157"),
        ("A / B / Ann Lee / ISBN: 9780306406157", "Ann Lee", "9780306406157", "course-citation", "A / B"), ("Signals / Ann Lee / ISBN 9783161484100", "Ann Lee", "9780306406157", "course-citation", "Signals / Ann Lee / ISBN 9783161484100"),
        ("Signals / Ann Lee / ISBN 9780306406157", "Ann Lee", "9780306406157", "library-bibliography", "Signals / Ann Lee / ISBN 9780306406157"), ("Signals", "Ann Lee", "9780306406157", "x", "Signals"), ("Signals / Ann Lee", "Ann Lee", "9780306406157", "x", "Signals / Ann Lee"),
        (" / unknown / ISBN 9780306406157", "unknown", "9780306406157", "x", " / unknown / ISBN 9780306406157"), ("Signals / Ann Lee / ISBN 9780306406157", "Ann Lee", "", "x", "Signals / Ann Lee / ISBN 9780306406157"), (" / Ann Lee / ISBN 9780306406157", "Ann Lee", "9780306406157", "x", " / Ann Lee / ISBN 9780306406157"),
    ],
    lambda: {"shown": N.display_title(c("title"), c("authors"), c("isbn"), c("origin"))},
)

rule(
    "course_keys", "E5 E6 J12", "university string, code string, title string, school string, key string", "u string, n string, t string, s string, f string",
    [
        ("MIT", "MIT 6.003", "Signals  and Systems", "", "k1", "mit", "6.003", "signals and systems", "", ""), ("Massachusetts Institute of Technology", "21w.735", "Writing", "MIT", "k2", "mit", "21w.735", "writing", "", ""),
        ("CMU", "15 213", "Systems", "School of CS", "k3", "carnegie-mellon", "15-213", "systems", "school of cs", ""), ("Carnegie Mellon", "cmu 15213", "Systems", None, "k4", "carnegie-mellon", "15-213", "systems", "", ""), ("carnegie mellon university", "15-2133", "Systems", "x", "k5", "carnegie-mellon", "15-2133", "systems", "x", ""),
        ("Yale", "No code listed", "History", "Yale University", "k6", "yale", "no code listed", "history", "", "k6"), ("Brown", "HIST 0100", "n/a", "", "k7", "brown", "hist 0100", "n/a", "", "k7"), ("Weill Cornell Medicine", "MD 1", "Anatomy", "Weill Cornell Medical College", "k8", "cornell", "md 1", "anatomy", "", ""),
        ("UC-Berkeley", None, "Robots", "Engineering", "k9", "berkeley", "", "robots", "engineering", "k9"),
    ],
    lambda: {k: N.course_key(c("university"), c("code"), c("title"), c("school"), c("key"))[f] for k, f in zip("untsf", ("university", "code", "title", "school", "fallback"), strict=True)},
)

rule(
    "book_keys", "E6", "matched string, candidate string, title string, authors string, edition string, status string, citation string, raw string, origin string, assigned string", "isbn string, named string, people string, ed string, apart string, kind string",
    [
        ("9780306406157", "", "Signals", "Ann Lee", "2nd ed", "course-source-isbn", "Signals", "0306406152", "course-citation", "9780306406157", "9780306406157", "signals", "ann lee", "2", "", ""),
        ("", "9783161484100", "Loads", "Cy", "Third edition", "publisher-edition-unconfirmed", "Loads", "", "not-stated", "", "9783161484100", "loads", "cy", "3", "", "publisher-edition-unconfirmed"),
        ("", "", "Loads ", "Cy", "Unknown", "missing", "LOADS, 1990", None, "not-stated", None, "", "loads", "cy", "", "loads, 1990||not-stated|missing", ""),
        ("9780306406157", None, "Signals", "Not stated", "2", "course-source-isbn", "S", "x", "course-citation", "", "9780306406157", "signals", "", "2", "s|x|course-citation|course-source-isbn", ""),
        ("", "", "Scales", "Di", "3", "invalid-course-source-isbn", "Scales", "123", "course-citation", "", "", "scales", "di", "3", "scales|123|course-citation|invalid-course-source-isbn", ""),
    ],
    lambda: dict(zip(("isbn", "named", "people", "ed", "apart", "kind"), (N.book_key({k: c(k) for k in ("matched", "candidate", "title", "authors", "edition", "status", "citation", "raw", "origin", "assigned")})[f] for f in ("isbn", "title", "authors", "edition", "unresolved", "kind")), strict=True)),
)

rule(
    "reading_roles", "E15", "said string", "role string",
    [("Required", "required"), (" required reading", "required"), ("requiredness", "not stated"), ("Optional - see desk", "optional/reference"), ("suggested", "optional/reference"), ("Not required", "not stated"), ("recommended but unconfirmed", "not stated"), ("reference", "optional/reference"), ("referenced", "not stated"), ("", "not stated"), (None, "not stated"), ("for reference", "not stated"), ("role unknown", "not stated")],
    lambda: {"role": N.reading_role(c("said"))},
    """SELECT CAST(l_orderkey * 10 + l_linenumber AS INT) AS case_no, CASE l_suppkey % 9 WHEN 0 THEN 'Required' WHEN 1 THEN concat(' required ', l_returnflag) WHEN 2 THEN 'not required' WHEN 3 THEN 'Optional - see desk' WHEN 4 THEN 'suggested' WHEN 5 THEN 'reference, unconfirmed' WHEN 6 THEN concat('referenced ', l_linestatus) WHEN 7 THEN '' END AS said FROM {lineitem}
      UNION ALL SELECT CAST(-1 - doc_id AS INT), CASE WHEN doc_id % 2 = 0 THEN concat('recommended: ', text) ELSE text END FROM {documents}""",
    r"""CASE WHEN regexp_matches(lower(said), 'not stated|not-stated|unconfirmed|not required|unknown') THEN 'not stated' WHEN split_part(regexp_replace(lower(trim(said)), '[^a-z0-9_]', ' ', 'g'), ' ', 1) IN ('optional', 'suggested', 'supplementary', 'supplemental', 'reference', 'recommended') THEN 'optional/reference'
      WHEN split_part(regexp_replace(lower(trim(said)), '[^a-z0-9_]', ' ', 'g'), ' ', 1) = 'required' THEN 'required' ELSE 'not stated' END AS role""",
)

rule(
    "token_support", "E17", "value string, citation string", "supported boolean",
    [("Ann Lee", "by ANN  lee, 2001", True), ("Ann Lee", "by Joann Lee", False), ("Lee", "Leeds", False), ("", "anything", False), (None, "anything", False), ("2nd ed.", "<b>2nd</b> Ed: Press", True), ("C++", "The C programming language", True), ("Lee Ann", "Ann Lee", False), ("x", None, False)],
    lambda: {"supported": N.supported(c("value"), c("citation"))},
    """SELECT CAST(doc_id AS INT) AS case_no, CASE doc_id % 5 WHEN 0 THEN split_part(text, ' ', 3) WHEN 1 THEN concat(split_part(text, ' ', 2), ' - ', split_part(text, ' ', 3)) WHEN 2 THEN source WHEN 3 THEN concat(split_part(text, ' ', 5), ' ', split_part(text, ' ', 4)) END AS value, text AS citation FROM {documents}
      UNION ALL SELECT CAST(-1 - p_partkey AS INT), p_type, CASE WHEN p_size % 3 = 0 THEN concat(p_name, ' (', lower(p_type), ')') ELSE concat(p_name, p_type) END FROM {part}""",
    f"""{_plain('value')} <> '' AND contains(' ' || {_plain('citation')} || ' ', ' ' || {_plain('value')} || ' ') AS supported""",
)

rule(
    "affirmed_roles", "E17", "evidence string, source string", "required boolean",
    [
        ("required", "This book is required.", True), ("required", "This book is not required.", False), ("required", "Not this one; that one is required.", True), ("required", "This isn't required", False), ("required", "No book, but Lee is required", True), ("required reading", "Lee: required reading", True),
        ("required reading", "Lee is never required reading", False), ("required", "nothing", False), ("", "required", False), (None, "required", False), ("optional", "required", False), ("required", "It is required and not optional", True), ("required", "requiredness", False), ("required", "Required! None required", True), ("not required", "It is not required", False),
    ],
    lambda: {"required": N.affirmed("required", c("evidence"), c("source"))},
)

rule(
    "code_aliases", "E33", "said string", "codes array<string>",
    [("HIST 101/201", ["hist101", "hist201"]), ("HIST 101/AFAM 201", ["afam201", "hist101"]), ("6.003", ["6003"]), ("EN.601 / 602", ["en601", "en602"]), ("Seminar/201", ["201", "seminar"]), ("CS-61A/61A", ["61a", "cs61a"]), ("", [""]), ("HIST 101 / hist-101", ["hist101"])],
    lambda: {"codes": N.code_aliases(c("said"))},
    """SELECT CAST(p_partkey AS INT) AS case_no, concat(p_type, CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '' END, CAST(p_size AS STRING), CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('/', CAST(p_size + 1 AS STRING)) WHEN 2 THEN concat(' / ', p_brand, '/', CAST(p_partkey AS STRING)) WHEN 3 THEN concat('/', p_type, ' ', CAST(p_size AS STRING)) ELSE '/' END) AS said FROM {part}""",
    r"""list_sort(list_distinct(list_transform(string_split(said, '/'), lambda p: lower(regexp_replace(CASE WHEN regexp_full_match(trim(p), '[0-9]+') THEN regexp_extract(trim(string_split(said, '/')[1]), '^(.*[^0-9])[0-9]+[A-Za-z0-9_]*$', 1) || trim(p) ELSE p END, '[^\pL\pN_]', '', 'g'))))) AS codes""",
)

rule(
    "year_range", "E23", "version string, quoted string", "years array<string>, agree boolean",
    [
        ("2024-25", "Fall 2025", ["2024", "2025"], True), ("Fall 2024", "Fall 2024 syllabus", ["2024"], True), ("Fall 2024", "Spring 2024", ["2024"], False), ("Fall 2024", "2024", ["2024"], False), ("2023", "updated 2024", ["2023"], False),
        ("version 1899", "1899", [], False), ("1999-00", "2000", ["1900", "1999"], False), ("Spring 2023, Fall 2024", "fall  2024", ["2023", "2024"], False), ("Spring 2023, Fall 2024", "FALL 2024", ["2023", "2024"], True), ("20245", "2024", [], False), ("2022 and 2023-24", "x 2024 y", ["2022", "2023", "2024"], True),
    ],
    lambda: {"years": N.years(c("version")), "agree": N.versions_agree(c("version"), c("quoted"))},
    """SELECT CAST(o_orderkey AS INT) AS case_no, CASE o_custkey % 6 WHEN 0 THEN concat(CAST(year(o_orderdate) AS STRING), '-', CAST(year(o_orderdate) % 100 + 1 AS STRING)) WHEN 1 THEN concat('Fall ', CAST(year(o_orderdate) AS STRING)) WHEN 2 THEN concat('Spring ', CAST(year(o_orderdate) AS STRING), ', fall  ', CAST(year(o_orderdate) + 1 AS STRING))
      WHEN 3 THEN CAST(o_orderkey AS STRING) WHEN 4 THEN concat('v', CAST(year(o_orderdate) AS STRING)) ELSE CAST(year(o_orderdate) AS STRING) END AS version, CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderpriority, ' ', CAST(year(o_orderdate) AS STRING)) WHEN 1 THEN concat('FALL ', CAST(year(o_orderdate) AS STRING))
      WHEN 2 THEN concat('spring ', CAST(year(o_orderdate) AS STRING), ' and ', CAST(year(o_orderdate) + 1 AS STRING)) WHEN 3 THEN concat('x', CAST(year(o_orderdate) AS STRING)) ELSE CAST(year(o_orderdate) + 1 AS STRING) END AS quoted FROM {orders}""",
    f"""{_YEARS} AS years, list_has_any({_YEARS}, {_NAMED}) AND (len({_terms('version')}) = 0 OR (len({_terms('quoted')}) > 0 AND len(list_filter({_terms('quoted')}, lambda x: NOT list_contains({_terms('version')}, x))) = 0)) AS agree""",
)


_FOUND = Fixture(
    "found",
    "source_order int, md5 string, title string, author string, year string, format string, isbns array<string>",
    (
        (1, "a" * 32, "Signals", "", None, "pdf", ["0306406152"]), (2, "a" * 32, "Signals and Systems", "Ann Lee", "2001", "epub", ["9780306406157", "0306406152"]), (3, "a" * 32, "Systems and Signals", "Bo", "1999", "", None),
        (1, "B" * 32, "Loads", "Cy", "2010", "", ["9783161484100"]), (2, None, "No sum", None, None, None, ["9780306406157"]), (3, None, "No sum", None, None, None, None), (1, "", "No sum", "x", "", "pdf", ["bad"]), (2, "zz", "Short sum", "", "", "", ["0-306-40615-2"]),
    ),
)


@query("E13", f"""
WITH {_FOUND.sql}, g AS (SELECT *, CASE WHEN coalesce(md5, '') = '' THEN row_number() OVER () END AS alone FROM found),
m AS (SELECT md5, alone, arg_max(title, length(title) * 10 - source_order) AS title, arg_min(author, source_order) FILTER (WHERE author <> '') AS author, arg_min(year, source_order) FILTER (WHERE year <> '') AS year, arg_min(format, source_order) FILTER (WHERE format <> '') AS format,
  flatten(list(coalesce(isbns, []) ORDER BY source_order)) AS every, count(*) AS n_sources FROM g GROUP BY md5, alone)
SELECT md5, title, author, year, format, list_filter(every, lambda x, i: list_position(every, x) = i) AS isbns, n_sources,
  CASE WHEN list_has_any(every, ['0306406152', '0-306-40615-2', '9780306406157']) THEN 'verified' WHEN list_has_any(every, ['9783161484100']) THEN 'different' ELSE 'unverified' END AS isbn_match FROM m""")
def source_merge_first_nonnull(t: Tables) -> DataFrame:
    return N.merged_results(_FOUND.frame(t.spark), "9780306406157")


@query("E14", "SELECT md5, title FROM (VALUES (repeat('a', 32), 'Signals and Systems')) v(md5, title)")
def verified_membership(t: Tables) -> DataFrame:
    return N.verified(N.merged_results(_FOUND.frame(t.spark), "9780306406157")).select("md5", "title")


_PACKED_COLUMNS = ["status", "priority", "customer", "year"]
_CODED = {"status": {0: "F", 1: "O", 2: "P"}, "priority": {0: "1-URGENT", 1: "2-HIGH", 2: "3-MEDIUM", 3: "4-NOT SPECIFIED", 4: "5-LOW"}}


def _packed(t: Tables) -> DataFrame:
    """All orders, packed in blocks of a thousand keys; every fifth customer's years are not known."""
    year = F.when(c("o_custkey") % 5 != 0, F.year("o_orderdate"))
    rows = t.orders.select("o_orderkey", c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority"), c("o_custkey").alias("customer"), year.alias("year"))
    return encoded_rows(rows, F.expr("o_orderkey div 1000"), "o_orderkey", _PACKED_COLUMNS, _CODED)


@query("E19", """
SELECT o_orderkey // 1000 AS set_id, o_orderkey AS ord, o_orderstatus AS status, o_orderpriority AS priority, o_custkey::VARCHAR AS customer, CASE WHEN o_custkey % 5 <> 0 THEN year(o_orderdate)::VARCHAR END AS year FROM orders""")
def decode_rows(t: Tables) -> DataFrame:
    """All orders, packed and spelled out again."""
    return N.decoded_rows(_packed(t), _PACKED_COLUMNS, _CODED)


@query("E19", """
SELECT * FROM (SELECT o_orderkey // 1000 AS set_id, o_orderkey AS ord, CASE WHEN o_orderkey % 1000 = 0 THEN 'nothing to repeat' WHEN o_custkey % 97 = 3 THEN 'mask too long' WHEN o_custkey % 89 = 5 THEN 'too many cells' WHEN o_custkey % 83 = 7 THEN 'incomplete' END AS fault FROM orders) WHERE fault IS NOT NULL""")
def decode_faults(t: Tables) -> DataFrame:
    """What is wrong with packed orders of which some were damaged, by the customer they are of."""
    key = t.orders.select(c("o_orderkey").alias("ord"), "o_custkey")
    start, long, more, none = c("ord") % 1000 == 0, c("o_custkey") % 97 == 3, c("o_custkey") % 89 == 5, c("o_custkey") % 83 == 7
    rows = _packed(t).join(key, "ord")
    harmed = rows.withColumns({
        "repeats": F.when(start, 1).when(long, c("repeats") + 16).otherwise(c("repeats")),
        "cells": F.when(start, F.slice("cells", 2, 99)).when(long, c("cells")).when(more, F.concat("cells", F.array(F.lit("x")))).when(none, None).otherwise(c("cells")),
    })
    return block_faults(harmed.drop("o_custkey"), _PACKED_COLUMNS, _CODED)


_EXPECTED_ROWS = Fixture("expected_fields", "key string, field string, value string", (("a", "title", "Signals"), ("a", "year", "2024"), ("b", "title", "Loads"), ("b", "term", "Fall"), ("c", "title", "X"), ("d", "title", "Y"), ("d", "year", ""), ("e", "title", "Z"), ("e", "other", "1")))
_SEEN_ROWS = Fixture("seen_fields", "key string, field string, value string", (("a", "title", " SIGNALS "), ("a", "title", "signals"), ("a", "year", "2024"), ("b", "title", "Loads"), ("c", "title", "X"), ("c", "year", "2020"), ("d", "title", "y"), ("d", "year", None), ("e", "title", "Z"), ("e", "other", "2"), ("f", "term", "x")))
_FIELDS = """SELECT CAST(l_orderkey AS STRING) AS key, 'title' AS field, {title} AS value FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey UNION ALL SELECT CAST(o_orderkey AS STRING), 'year', CAST(year(o_orderdate) AS STRING) FROM {{orders}} WHERE {year}
  UNION ALL SELECT CAST(o_orderkey AS STRING), 'term', {term} FROM {{orders}} UNION ALL SELECT CAST(o_orderkey AS STRING), 'other', {other} FROM {{orders}}"""
_EXPECTED = Bound(_EXPECTED_ROWS, _FIELDS.format(title="p_name", year="o_custkey % 10 <> 1", term="o_orderpriority", other="'1'"))
_SEEN = Bound(_SEEN_ROWS, _FIELDS.format(title="CASE WHEN l_suppkey % 41 = 0 THEN p_type ELSE concat(' ', upper(p_name)) END", year="o_custkey % 10 <> 2", term="CASE WHEN o_custkey % 7 = 3 THEN ' ' ELSE lower(o_orderpriority) END", other="o_orderstatus"))


@query("E18", f"""
WITH {_EXPECTED.sql}, {_SEEN.sql}, a AS (SELECT key, field, list_sort(list(DISTINCT lower(trim(value)))) AS v FROM expected_fields WHERE field <> 'other' AND trim(coalesce(value, '')) <> '' GROUP BY ALL),
b AS (SELECT key, field, list_sort(list(DISTINCT lower(trim(value)))) AS v FROM seen_fields WHERE field <> 'other' AND trim(coalesce(value, '')) <> '' GROUP BY ALL)
SELECT coalesce(a.key, b.key) AS key, bool_and(coalesce(a.v = b.v, false)) AS same FROM a FULL JOIN b ON a.key = b.key AND a.field = b.field GROUP BY 1""")
def set_equality(t: Tables) -> DataFrame:
    return N.same_identity(_EXPECTED.frame(t), _SEEN.frame(t), ["title", "year", "term"])
