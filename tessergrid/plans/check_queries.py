"""Checks, caches, mirrors, filters and renderings, on awkward rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup, render

from ..operators import checks as K
from ..operators import classify
from ..operators import identities as N
from ..registry import query
from ..session import Tables
from . import brief
from . import fixtures as X
from .fixtures import Fixture
from .identity_queries import rule

c = F.col

rule(
    "match_bases", "J10 E29", "basis string, university string, source_code string, source_title string, code string, title string, rationale string, excerpt string", "fault string",
    [
        (None, "mit", "6.003", "Signals", "6-003", "Signals!", None, None, "codes differ"), ("exact-code-and-title", "mit", "EE 6003", "Signals", "ee-6003", "<i>signals</i>", None, None, None), (None, "mit", "6.003", "Signals", "6.003", "Systems", None, None, "titles differ"),
        ("official-code-with-title-variant", "mit", "6.003", "Signals", "6.003", "Systems", "renamed", None, None), ("official-code-with-title-variant", "mit", "6.003", "Signals", "6.003", "Systems", " ", None, "no rationale"), ("official-renumbering", "mit", "6.003", "S", "6.3000", "S", "renumbered", "6.003 is now 6.3000. Enrol", None),
        ("official-code-alias", "mit", "6.003", "S", "6.3000", "S", "renumbered", "16.003 is now 6.3000.", "excerpt lacks a code"), ("official-renumbering", "mit", "6.003", "S", "6.3000", "S", None, "6.003 is now 6.3000", "no rationale"), ("official-yale-term-suffix", "yale", "HIST 1234", "H", "HIST 1234a", "H", "fall", "HIST 1234a H", None),
        ("official-yale-term-suffix", "mit", "HIST 1234", "H", "HIST 1234a", "H", "fall", "HIST 1234a H", "no term suffix"), ("official-yale-term-suffix", "yale", "HIST 123", "H", "HIST 123a", "H", "fall", "HIST 123a H", "no term suffix"), ("official-yale-term-suffix", "yale", "HIST 1234", "H", "HIST 1234b", "H", "spring", "HIST 1234 b, Horses", "not in the official catalogue"),
        ("guess", "mit", "6.003", "S", "6.003", "S", "x", "x", "unknown basis"),
    ],
    lambda: {"fault": N.basis_fault({k: c(k) for k in ("basis", "university", "source_code", "source_title", "code", "title", "rationale", "excerpt")})},
)

rule(
    "public_urls", "E16", "url string", "public boolean",
    [
        ("https://example.org/a?b=1", True), ("HTTP://Example.org", True), ("ftp://example.org", False), ("https://user@example.org/", False), ("https://user:pw@example.org/", False), ("https://example.org/?api_key=1", False), ("https://example.org/?b=1&X-Access-Token=2", False), ("https://example.org/?token=", True),
        ("https://example.org/token/x", True), ("https://example.org/#token=1", True), ("https:///path", False), ("https://", False), ("//example.org", False), ("", False), (None, False), ("https://example.org/?q=secret", True), ("https://example.org:8080/?apikey=z", False), ("https://example.org/a@b", True),
    ],
    lambda: {"public": N.public_link(c("url"))},
)

rule(
    "distribution_check", "E28", "probabilities string, answer string", "faults array<string>",
    [
        ('{"a": 0.9, "b": 0.1}', "a", []), ('{"a": 0.9, "b": 0.1}', "b", ["argmax"]), ('{"a": 0.5, "b": 0.5}', "b", []), ('{"a": 1.2, "b": -0.2}', "a", ["range"]), ('{"a": 0.9, "b": 0.12}', "a", ["sum"]), ('{"a": 0.9, "b": 0.105}', "a", []), ('{"a": 0.9, "b": 0.1}', "c", ["argmax"]), ('{"a": 1.0}', "a", []), ('{"a": 0.99}', "a", ["sum"]),
        ('{"a": 0.2, "b": 0.2, "c": 0.2, "d": 0.2, "e": 0.2, "f": 0.02}', "a", []), ('{"a": 0.2, "b": 0.2, "c": 0.2, "d": 0.2, "e": 0.2, "f": 0.03}', "a", ["sum"]),
    ],
    lambda: {"faults": classify.distribution_faults(F.from_json("probabilities", "map<string,double>"), c("answer"))},
)

rule(
    "magic_bytes", "E31", "head string", "format string",
    [("255044462D312E37", "pdf"), ("0A255044462D", "unknown"), ("504B0304AA", "epub"), ("504B0506", "unknown"), ("41542654464F524D00", "djvu"), ("41542654", "unknown"), ("00" * 60 + "424F4F4B4D4F4249", "mobi"), ("00" * 61 + "424F4F4B4D4F4249", "unknown"), ("", "unknown")],
    lambda: {"format": markup.file_format(F.unhex("head"))},
)

_HTML = "<h1>One &amp; <b>two</b></h1><script>var h = '<h2>no</h2>';</script><p>Text<br>line</p><style>h3{}</style><img src=a.png alt='A figure'><h2> </h2><p>If <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math></p><h3>Deep<h3>Deeper</h3><img src=b.png>"
rule(
    "html_structures", "S11", "html string", "text string, headings array<string>, images array<string>",
    [
        (_HTML, "\nOne & two\n\nText\nline\nA figure\n \n\nIf <math><mi>x</mi><mo><</mo><mn>2</mn></math>\n\nDeep\nDeeper\n", ["1 One & two 1", "2  31", "3 Deeper 87"], ["a.png A figure 22", "b.png  94"]),
        ("<p>open", "\nopen", [], []), ("", "", [], []), (None, "", [], []), ("plain", "plain", [], []), ("<script>never closed", "", [], []),
    ],
    lambda: {
        "text": markup.html_structure(c("html"))["text"],
        "headings": F.transform(markup.html_structure(c("html"))["headings"], lambda h: F.concat_ws(" ", h["level"].cast("string"), h["title"], h["offset"].cast("string"))),
        "images": F.transform(markup.html_structure(c("html"))["images"], lambda i: F.concat_ws(" ", i["src"], i["alt"], i["offset"].cast("string"))),
    },
)

rule(
    "markdown_outline", "S13", "text string", "headings array<string>",
    [("# One\n\ntext # no\n## Two ##\n####### seven\n#none\n### Three\t", ["1 One 0", "2 Two 17", "3 Three 47"]), ("", []), (None, []), ("text\n# Last", ["1 Last 5"]), ("#  Spaced  \r\n", ["1 Spaced 0"])],
    lambda: {"headings": F.transform(markup.markdown_headings(c("text")), lambda h: F.concat_ws(" ", h["level"].cast("string"), h["title"], h["offset"].cast("string")))},
)

rule(
    "rendered_lines", "K11", "title string, url string", "html string, markdown string",
    [
        ("Signals & <Systems>", "https://x.example/a?b='1'&c=2", '<a href="https://x.example/a?b=&#x27;1&#x27;&amp;c=2" rel="noreferrer">Signals &amp; &lt;Systems&gt;</a>', "[Signals & \\<Systems\\>](https://x.example/a?b='1'&c=2)"), ("Plain", "javascript:alert(1)", "Plain", "Plain"), ('"Q" \'q\'', None, "&quot;Q&quot; &#x27;q&#x27;", "\"Q\" 'q'"),
        ("a_b*c\n# d", "https://u@x.example", "a_b*c\n# d", "a\\_b\\*c \\# d"), (None, "https://x.example/(a)", '<a href="https://x.example/(a)" rel="noreferrer"></a>', "[](https://x.example/a)"),
    ],
    lambda: {"html": render.html_link(c("title"), c("url")), "markdown": render.markdown_link(c("title"), c("url"))},
)

rule(
    "harvested_urls", "E15", "payload string", "urls array<string>",
    [
        ('{"source_url": "https://b.example/x", "more": {"urls": ["http://a.example", "ftp://c", "https://b.example/x"], "note": "https://no.example"}}', ["http://a.example", "https://b.example/x"]), ('[{"course_url_list": []}, {"deep": [{"url": "https://d.example?q=1"}]}]', ["https://d.example?q=1"]),
        ('{"url": null, "urls": ["https://", "https:///x"]}', []), ("", []), (None, []), ('{"URL": "https://upper.example"}', []), ('{"link": "https://e.example"}', []),
    ],
    lambda: {"urls": N.harvested_urls(c("payload"))},
)

_REVIEWED = Fixture("records", "course_key string, source_fingerprint string, classification_fingerprint string, status string, urls array<string>, texts array<string>", (("a", "s", "c", "candidate", ["u1", "u2"], ["Signals and Systems", "On the history of loads."]), ("b", "s", "c", "reviewed", ["u1"], ["x"])))
_REVIEWS = Fixture(
    "reviews",
    "n int, course_key string, source_fingerprint string, classification_fingerprint string, reviewer string, rationale string, urls array<string>, quotes array<string>, area_ids array<string>, main string",
    (
        (1, "a", "s", "c", "me", "fits", ["u1", "u2"], ["signals AND", "history, of"], ["law", "art"], "art"), (2, "zz", "s", "c", "me", "fits", ["u1"], ["x"], ["law"], "law"), (3, "b", "s", "c", "me", "fits", ["u1"], ["x"], ["law"], "law"), (4, "a", "old", "c", "me", "fits", ["u1"], ["Signals"], ["law"], "law"), (5, "a", "s", "c", " ", "fits", ["u1"], ["Signals"], ["law"], "law"),
        (6, "a", "s", "c", "me", "fits", [], [], ["law"], "law"), (7, "a", "s", "c", "me", "fits", ["u9"], ["Signals"], ["law"], "law"), (8, "a", "s", "c", "me", "fits", ["u1"], ["Noise"], ["law"], "law"), (9, "a", "s", "c", "me", "fits", ["u1"], ["!"], ["law"], "law"), (10, "a", "s", "c", "me", "fits", ["u1"], ["Signals"], ["law", "law"], "law"),
        (11, "a", "s", "c", "me", "fits", ["u1"], ["Signals"], ["war"], "war"), (12, "a", "s", "c", "me", "fits", ["u1"], ["Signals"], ["law"], "art"), (13, "a", "s", "c", "me", "fits", ["u1"], ["Signals"], [], None),
    ),
)


@query("R6 P10", """
SELECT * FROM (VALUES (1, NULL), (2, 'unknown course'), (3, 'already reviewed'), (4, 'stale'), (5, 'unsigned'), (6, 'no evidence'), (7, 'foreign source'), (8, 'quote not in course'), (9, 'quote not in course'), (10, 'repeated or unknown areas'), (11, 'repeated or unknown areas'), (12, 'primary not among areas'), (13, 'primary not among areas')) v(n, fault)""")
def review_faults(t: Tables) -> DataFrame:
    evidence = F.zip_with("urls", "quotes", lambda u, q: F.struct(u.alias("url"), q.alias("quote")))
    reviews = _REVIEWS.frame(t.spark).select("*", evidence.alias("evidence"), c("main").alias("primary")).drop("urls", "quotes", "main")
    out = None
    for n in range(1, len(_REVIEWS.rows) + 1):  # one course has several here; each is judged alone
        one = K.review_faults(_REVIEWED.frame(t.spark), reviews.where(c("n") == n).drop("n"), ["law", "art"]).select(F.lit(n).alias("n"), "fault")
        out = one if out is None else out.unionByName(one)
    return out


_TAGS = Fixture("tags", "n int, id string, label string, kind string, quote string", ((1, "law", "Law", "course", "q"), (2, "Law", "Law", "course", "q"), (3, "tax-law", "", "course", "q"), (4, "tax-law", "x" * 201, "course", "q"), (5, "tax-law", "x" * 200, "other", "q"), (6, "a" * 101, "A", "reading", "q"), (7, "law-", "L", "reading", "q"), (8, "law2", "L", "reading", "q" * 2001), (9, None, "L", "reading", "q")))


@query("F9", "SELECT n, id, label, CASE WHEN n = 1 THEN 1 ELSE 0 END AS anchors FROM (VALUES (1, 'law', 'Law'), (5, 'tax-law', repeat('x', 200)), (8, 'law2', 'L')) v(n, id, label)")
def compact_tags(t: Tables) -> DataFrame:
    made = F.array(F.struct("id", "label", F.array(F.struct("kind", "quote")).alias("anchors")))
    return _TAGS.frame(t.spark).select("n", F.explode(K.compact_tags(made)).alias("t")).select("n", "t.id", "t.label", F.size("t.anchors").alias("anchors"))


_EVIDENCE = Fixture(
    "evidence",
    "course_key string, evidence_id string, institution string, code string, title string, source_year string, source_url string, verification string",
    tuple(
        (k, e, i, "1", "T", y, u, v)
        for k, e, i, y, u, v in (
            ("a", "e1", "MIT", "2024", "https://x.example", "reviewed-primary-source"), ("b", "e2", "Nowhere", "2024", "https://x.example", "reviewed-primary-source"), ("c", "e3", "MIT", "", "https://x.example", "reviewed-primary-source"), ("d", "e4", "MIT", "2024", "ftp://x", "reviewed-primary-source"), ("e", "e5", "MIT", "2024", "https://x.example", "guess"),
            ("f", "e6", "MIT", "2024", "https://x.example", "reviewed-primary-source"), ("g", "e7", "MIT", "2024", "https://x.example", "reviewed-primary-source"), ("h", "e8", "MIT", "2024", "https://x.example", "reviewed-primary-source"), ("i", "e9", "MIT", "2024", "https://x.example", "reviewed-primary-source"), ("j", "e0", "MIT", "2024", "https://x.example", "reviewed-primary-source"), ("k", "e0", "MIT", "2024", "https://x.example", "reviewed-primary-source"),
        )
    ),
)
_ITEMS = Fixture(
    "items",
    "course_key string, line int, kind string, title string, exact_title string, role string, source_year string, verification string",
    (("a", 1, "book", "Signals", None, "required", None, None), ("a", 2, "book", "Loads", "Loads", "optional", "2020", "own"), ("b", 1, "book", "S", None, "required", None, None), ("g", 1, "statement", "None", None, "required", None, None), ("h", 1, "book", "S", "Z", "required", None, None), ("i", 1, "book", "S", None, "maybe", None, None), ("j", 1, "book", "S", None, "required", None, None)),
)


@query("E34", "SELECT * FROM (VALUES ('a', NULL), ('b', 'out of scope'), ('c', 'incomplete'), ('d', 'no public source'), ('e', 'not reviewed'), ('f', 'no materials'), ('g', 'not a named book'), ('h', 'titles differ'), ('i', 'unknown role'), ('j', 'repeated'), ('k', 'repeated')) v(course_key, fault)")
def course_evidence_faults(t: Tables) -> DataFrame:
    return K.course_evidence(_EVIDENCE.frame(t.spark), _ITEMS.frame(t.spark))[0]


@query("E34", "SELECT * FROM (VALUES ('a', 1, 'Signals', 'Signals', '2024', 'reviewed-primary-source'), ('a', 2, 'Loads', 'Loads', '2020', 'own')) v(course_key, line, title, exact_title, source_year, verification)")
def inherited_defaults(t: Tables) -> DataFrame:
    return K.course_evidence(_EVIDENCE.frame(t.spark), _ITEMS.frame(t.spark))[1]


_WANTED = Fixture("wanted_books", "book int, title string, isbn string, finding string, basis string", ((0, "Signals", "0306406152", "9783161484100", "publisher"), (1, "Loads", "bad", "9783161484100", "library-title-only-candidate"), (2, "Scales", None, "978-0-306-40615-7", "catalog"), (3, "Beams", "9780306406157", "0306406152", "catalog"), (4, "Cells", None, "9783161484100", ""), (5, "None", None, None, None)))


@query("E12", "SELECT * FROM (VALUES (0, 'Signals', ['9780306406157', '9783161484100'], 'ready'), (1, 'Loads', []::VARCHAR[], 'no-supported-isbn'), (2, 'Scales', ['9780306406157'], 'ready'), (3, 'Beams', ['9780306406157'], 'ready'), (4, 'Cells', [], 'no-supported-isbn'), (5, 'None', [], 'no-supported-isbn')) v(book, title, isbns, status)")
def search_plan(t: Tables) -> DataFrame:
    rows = _WANTED.frame(t.spark).withColumn("findings", F.when(c("finding").isNotNull(), F.array(F.struct(c("finding").alias("isbn"), "basis"))))
    return K.search_plan(rows)


_BODY = b"%PDF-1.7 a book"
_S, _M = hashlib.sha256(_BODY).hexdigest(), hashlib.md5(_BODY).hexdigest()
_CLAIMED = Fixture(
    "claimed",
    "path string, status string, isbn_match string, format string, sha256 string, md5 string, bytes bigint, checks array<string>, checked_at string",
    tuple(
        (p, st, "verified", f, s, _M, n, ch, at)
        for p, st, f, s, n, ch, at in (
            ("/s/checked/a.pdf", "file_verified", "pdf", _S, 15, list(K.FILE_CHECKS) + ["more"], "now"), ("/s/checked/b.pdf", "downloaded", "pdf", _S, 15, [], None), ("/s/other/c.pdf", "file_verified", "pdf", _S, 15, list(K.FILE_CHECKS), "now"), ("/s/checked/../d.pdf", "file_verified", "pdf", _S, 15, list(K.FILE_CHECKS), "now"),
            ("/s/checked/e.pdf", "file_verified", "pdf", _S, 15, list(K.FILE_CHECKS), "now"), ("/s/checked/f.doc", "file_verified", "doc", _S, 15, list(K.FILE_CHECKS), "now"), ("/s/checked/g.pdf", "file_verified", "pdf", "0", 15, list(K.FILE_CHECKS), "now"), ("/s/checked/h.pdf", "file_verified", "pdf", _S, 14, list(K.FILE_CHECKS), "now"),
            ("/s/checked/i.pdf", "file_verified", "pdf", _S, 15, ["catalog-md5"], "now"), ("/s/checked/j.pdf", "file_verified", "pdf", _S, 15, list(K.FILE_CHECKS), " "),
        )
    ),
)


@query("E35", """
SELECT * FROM (VALUES ('/s/checked/a.pdf', NULL), ('/s/other/c.pdf', 'outside the selection'), ('/s/checked/../d.pdf', 'outside the selection'), ('/s/checked/e.pdf', 'no file'), ('/s/checked/f.doc', 'unsupported format'), ('/s/checked/g.pdf', 'changed'), ('/s/checked/h.pdf', 'changed'), ('/s/checked/i.pdf', 'unchecked'), ('/s/checked/j.pdf', 'unchecked')) v(path, fault)""")
def file_faults(t: Tables) -> DataFrame:
    there = [r[0] for r in _CLAIMED.rows if not r[0].endswith("/e.pdf")]
    files = t.spark.createDataFrame([(p,) for p in there], "path string").withColumn("content", F.lit(bytearray(_BODY)))
    return K.file_faults(_CLAIMED.frame(t.spark), files, "/s/checked")


_UNITS = Fixture("units", "source string, parent string, unit string, fingerprint string, bytes int", tuple(("s1", f"p{i // 3}", f"u{i}", f"f{i}", 40) for i in range(9)) + (("s2", "p9", "v1", "g1", 10),))
_VECTORS = Fixture("vectors", "unit string, fingerprint string", (("u0", "f0"), ("u1", "old"), ("u2", "f2"), ("v1", "g1"), ("x1", "h1"), ("x2", "h2")))
_COVERED = Fixture("covered", "parent string, unit string", (("p0", "u0"), ("p0", "x1"), ("p0", "x3"), ("gone", "x2")))


@query("T15 M1", "SELECT * FROM (VALUES ('s1', 'u1', 0), ('s1', 'u3', 0), ('s1', 'u4', 1), ('s1', 'u5', 1), ('s1', 'u6', 2), ('s1', 'u7', 2), ('s1', 'u8', 3)) v(source, unit, batch)")
def index_batches(t: Tables) -> DataFrame:
    return K.index_plan(*[x.frame(t.spark) for x in (_UNITS, _VECTORS, _COVERED)], 2, 1000)[0]


@query("T15 A18", "SELECT * FROM (VALUES ('p0', 2, 3, 'partial'), ('p1', 0, 3, 'partial'), ('p2', 0, 3, 'partial'), ('p9', 1, 1, 'complete')) v(parent, done, total, status)")
def index_coverage(t: Tables) -> DataFrame:
    return K.index_plan(*[x.frame(t.spark) for x in (_UNITS, _VECTORS, _COVERED)], 2, 1000)[2]


@query("T15", "SELECT 'x1' AS unit")
def index_stale(t: Tables) -> DataFrame:
    return K.index_plan(*[x.frame(t.spark) for x in (_UNITS, _VECTORS, _COVERED)], 2, 1000)[1]


@query("A18", """
WITH d AS (SELECT doc_id, text FROM documents WHERE text <> ''), r AS (SELECT doc_id, unnest(range(0, (length(text) + 499) // 500)) AS r, text FROM d)
SELECT doc_id, count(*) AS regions, bool_and(NOT (doc_id % 5 = 0 AND contains(substr(text, r * 500 + 1, 500), 'q'))) AS sound FROM r GROUP BY doc_id""")
def unit_coverage(t: Tables) -> DataFrame:
    """Regions against the text that units were made of; in every fifth document the q of a region was lost on the way."""
    from ..functions import units as U

    regions = U.regions(t.documents.where("text <> ''"), "doc_id", "text", 500)
    kept = F.when(c("doc_id") % 5 == 0, F.translate("region_text", "q", "")).otherwise(c("region_text"))
    return regions.withColumn("joined", kept).groupBy("doc_id").agg(F.count("*").alias("regions"), F.bool_and(c("joined") == c("region_text")).alias("sound"))


_SEARCHES = Fixture(
    "searches",
    "seq int, at double, query string, sources array<string>, most int, refresh boolean, complete boolean, results int",
    (
        (1, 0.0, "0-306-40615-2", ["b", "a"], 10, False, True, 3), (2, 10.0, "9780306406157", ["a", "b", "a"], 10, False, True, 3), (3, 299.0, "0306406152", ["a", "b"], 10, True, True, 0), (4, 320.0, "0306406152", ["a", "b"], 10, False, True, 0), (5, 329.0, "0306406152", ["a", "b"], 10, False, False, 5), (6, 330.0, "0306406152", ["a", "b"], 10, False, True, 5), (7, 600.0, "0306406152", ["a", "b"], 10, False, True, 1),
        (8, 631.0, "0306406152", ["a", "b"], 10, False, True, 1), (9, 5.0, "9780306406157", ["a"], 10, False, True, 1), (10, 6.0, "9780306406157", ["a"], 20, False, True, 1), (11, 7.0, " loads ", ["a"], 10, False, True, 0), (12, 36.9, "loads", ["a"], 10, False, True, 0), (13, 37.0, "loads", ["a"], 10, False, True, 0),
    ),
)


@query("Q7", "SELECT seq, CASE WHEN seq IN (2, 4, 7, 12) THEN 'cached' ELSE 'run' END AS outcome FROM (SELECT unnest(range(1, 14))::INTEGER AS seq)")
def cached_searches(t: Tables) -> DataFrame:
    return K.cached_searches(_SEARCHES.frame(t.spark))


_MIRRORS = Fixture("mirrors", "grp string, place int, mirror string", (("g", 1, "m1"), ("g", 2, "m2"), ("g", 3, "m3"), ("g", 4, "m4"), ("g", 5, "m5"), ("h", 1, "n1"), ("h", 2, "n2")))
_TRIES = Fixture("tries", "grp string, mirror string, at double, code string, status int", (("g", "m1", 80.0, "timeout", None), ("g", "m2", 60.0, "network_error", None), ("g", "m3", 50.0, "ok", 200), ("g", "m3", 90.0, "http_error", 404), ("g", "m4", 95.0, "http_error", 503), ("g", "m4", 40.0, "ok", 200), ("g", "m5", 99.0, "unexpected_page", 200), ("h", "n1", 99.0, "timeout", None), ("h", "n1", 99.5, "ok", 200), ("h", "n2", 120.0, "timeout", None)))


@query("Q8", "SELECT * FROM (VALUES ('g', 'm3', 1, 'eligible'), ('g', 'm2', 2, 'eligible'), ('g', 'm5', 3, 'eligible'), ('g', 'm1', NULL, 'cooldown:timeout'), ('g', 'm4', NULL, 'cooldown:http_error'), ('h', 'n1', 1, 'eligible'), ('h', 'n2', 2, 'eligible')) v(grp, mirror, turn, state)")
def mirror_order(t: Tables) -> DataFrame:
    return K.mirror_order(_MIRRORS.frame(t.spark), _TRIES.frame(t.spark), 100.0)


_FILTERED = Fixture(
    "filtered",
    "course_id string, institution string, areas array<string>, levels array<string>, status string",
    (
        ("c1", "MIT", ["Engineering"], ["Graduate"], "reviewed"), ("c2", "Massachusetts Institute of Technology", ["ENGINEERING", "law"], ["graduate"], "candidate"), ("c3", "Yale University", ["history"], ["graduate"], "reviewed"), ("c4", "mit", ["engineering"], ["undergraduate"], "reviewed"), ("c6", "Yale", ["engineering"], None, "reviewed"),
        ("c8", "Brown", ["engineering"], ["graduate"], "reviewed"), ("c9", "MIT", [], ["graduate"], "reviewed"), ("c10", "yale", ["Engineering"], ["GRADUATE"], "reviewed"), ("c11", "MIT", None, ["graduate"], "reviewed"),
    ),
)


@query("F4 T6", f"""
WITH {_FILTERED.sql}, {X.COURSE_FIELDS.sql} SELECT course_id FROM filtered WHERE lower(institution) IN ('mit', 'massachusetts institute of technology', 'yale', 'yale university') AND list_has_any(list_transform(areas, lambda a: lower(a)), ['engineering', 'history'])
  AND list_has_any(list_transform(levels, lambda a: lower(a)), ['graduate']) AND status = 'reviewed' AND course_id NOT IN (SELECT course_id FROM course_fields WHERE regexp_matches(lower(text), 'select(ed|ing)? treatments?'))""")
def passing_courses(t: Tables) -> DataFrame:
    return K.passing(_FILTERED.frame(t.spark), X.COURSE_FIELDS.frame(t.spark), institutions=["MIT", "Yale"], exclude=["choosing treatments", "!"], areas=["Engineering", "HISTORY"], levels=["graduate"], reviewed=True).select("course_id")


_READ = Fixture("readings", "course_key string, institution string, code string, title string, named_books int, nondegree boolean", (("k1", "MIT", "6.003", "Signals", 0, None), ("k2", "mit", "6. 003", "signals", 2, False), ("k3", "Yale", "H 1", "History", 0, False), ("k4", "Yale", "H 2", "Zoo", 0, None), ("k5", "Yale", "H 3", "Evening", 3, True), ("k6", "Yale", "H 4", "Art", 0, False)))


@query("P9", "SELECT 'usable' AS part, 'Signals' AS title, ['k1', 'k2'] AS keys UNION ALL SELECT 'backlog', 'Art', ['k6'] UNION ALL SELECT 'backlog', 'History', ['k3']")
def discovery_backlog(t: Tables) -> DataFrame:
    usable, backlog = K.discovery(_READ.frame(t.spark), 2)
    return usable.select(F.lit("usable").alias("part"), "title", c("source_keys").alias("keys")).unionByName(backlog.select(F.lit("backlog").alias("part"), "title", F.array("course_key").alias("keys")))


_SAID = "Must calibrate robot sensors, optional machine vision, not drones or kites; already knows linear algebra, calculus. Use only MIT. Optional robot sensors! Nice to have: 6.003 notes but without exams"


@query("R14", """
SELECT * FROM (VALUES ('capability', 'calibrate robot sensors', 'essential'), ('capability', 'machine vision', 'supplemental'), ('capability', 'robot sensors', 'supplemental'), ('capability', '6.003 notes', 'supplemental'), ('exclude', 'drones or kites', NULL), ('exclude', 'exams', NULL),
  ('known', 'linear algebra', NULL), ('known', 'calculus', NULL), ('institution', 'mit', NULL), ('constraint', 'Use only MIT', NULL)) v(kind, said, priority)""")
def brief_intent(t: Tables) -> DataFrame:
    got = brief.extract_intent(_SAID, {"MIT": "mit"})
    rows = [("capability", x["description"], x["priority"]) for x in got["capabilities"]]
    for kind, name in (("exclude", "exclude"), ("known", "existing_knowledge"), ("institution", "institutions"), ("constraint", "constraints")):
        rows += [(kind, x, None) for x in got[name]]
    return t.spark.createDataFrame(rows, "kind string, said string, priority string")


@query("W14 W13", "SELECT * FROM (VALUES (1, 239, 0), (2, 239, 0), (3, 50, 0), (4, 239, 0)) v(id, kept, left_out)")
def bounded_answer(t: Tables) -> DataFrame:
    """Four answers cut to 1,000 bytes: the long ones to one length, the short one not at all."""
    rows = [{"id": i, "text": ("x" if i != 3 else "y") * (3000 if i != 3 else 50)} for i in range(1, 5)]
    kept, out = brief.bounded(rows, 859)
    return t.spark.createDataFrame([(r["id"], len(r["text"]), out) for r in kept], "id int, kept int, left_out int")


