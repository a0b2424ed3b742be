"""Result pages, reading lists and JSON answers, on awkward pages and values."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..registry import query
from ..session import Tables
from .fixtures import Fixture

A, B, C = "a" * 32, "0123456789abcdef" * 2, "f" * 32
_ROWS = f"""<table><tr><th>Author</th><th>Title</th></tr>
<tr><td>Ann Lee</td><td><a href="book.php?id=1">Signals &amp; <b>Systems</b></a> <a href="x">12345</a></td><td>2001, English</td><td>pdf</td><td>3.5 MB</td><td><a href="/ads.php?md5={A.upper()}">Libgen mirror of the very same book</a></td></tr>
<tr><td>Again</td><td><a href="/md5/{A}">The same file under a longer title than before</a></td><td>1999</td></tr>
<tr><td></td><td><a href="https://x.example/md5/{B}">Loads</a><a>[1]</a></td><td>1499 to 2099, GERMAN EPUB 700KB</td></tr>
<tr><td>short</td><td><a href="?md5={C}">Two cells only</a></td></tr><tr><td>x</td><td><a href="?md5={C}">mirror</a></td><td>y</td></tr>
<tr><td>{"long " * 30}</td><td><a href="?md5={C[:31]}">No hash</a></td><td>2000</td></tr><tr><td>{"long " * 30}</td><td><a href="?MD5={C}">Unclosed<td>fb2 2024 Dutch</tr></table>"""
_PAGES = Fixture("result_pages", "page string, html string", (("rows", _ROWS), ("none", "<p>nothing</p>"), ("empty", ""), ("null", None)))


@query("E30", f"""
SELECT page, md5, title, author, year, format, size, language FROM (VALUES ('rows', 0, '{A}', 'Signals & Systems', 'Ann Lee', '2001', 'PDF', '3.5 MB', 'English'), ('rows', 1, '{B}', 'Loads', NULL, '2099', 'EPUB', '700KB', 'GERMAN'),
  ('rows', 2, '{C}', 'Unclosedfb2 2024 Dutch', NULL, '2024', 'FB2', NULL, 'Dutch')) v(page, place, md5, title, author, year, format, size, language)""")
def result_fields(t: Tables) -> DataFrame:
    return _PAGES.frame(t.spark).select("page", F.explode(P.results(F.col("html"), 3)).alias("r")).select("page", "r.*")


_LIST = """<main><h2>Required books</h2><ul><li>Lee, Ann. <em>Signals and Systems</em>. 2nd ed. ISBN 0-306-40615-2.</li><li>Lee, Ann. <em>Signals  and Systems.</em> 2nd ed. ISBN 0-306-40615-2</li>
<li>Li, Bo. <i>Loads</i>. Third edition</li><li>Day, Cy. "An article." <em>Loads Today</em>. Wiley, 1999</li><li>Day, Cy. <em>Journal of Loads</em>. Wiley, 1999</li><li><p>Nested: Orr, Di. <em>Inner</em>. MIT Press, 2001.</p></li></ul>
<h3>Further</h3><p>Optional: the reader. <em>Scales</em>. Springer, 2010</p><p><em>One</em> and <em>Two</em>. Wiley, 2000</p><p>Kay, El. In <em>Collected Works</em>. Norton, 1988.</p><p>Not required: Poe, Fy. <em>Beams</em>. Penguin, 1950</p><p>Vague, Gi. <em>Nothing</em>. Somewhere</p>
<table><tr><td>Hu, Jo. <em>Cells</em>. Pearson Publishing, 2015</td></tr></table><p>Unclosed Ka. <em>Open</em>. Harper, 1977<p>Next</main>"""
_LISTS = Fixture("reading_lists", "page string, html string", (("list", _LIST), ("empty", ""), ("null", None), ("long", f"<p>Xu, Li. <em>Long</em>. Wiley, 2000 {'x' * 4000}</p>")))


@query("E25", """
SELECT page, title, author, edition, isbn, role FROM (VALUES
  ('list', 'Signals and Systems', 'Lee, Ann', '2nd ed.', '0-306-40615-2', 'required'), ('list', 'Loads', 'Li, Bo', 'Third edition', NULL, 'required'), ('list', 'Inner', NULL, NULL, NULL, 'required'), ('list', 'Scales', NULL, NULL, NULL, 'optional'),
  ('list', 'Collected Works', NULL, NULL, NULL, 'not-stated'), ('list', 'Beams', NULL, NULL, NULL, 'required'), ('list', 'Cells', 'Hu, Jo', NULL, NULL, 'not-stated'), ('list', 'Open', 'Unclosed Ka', NULL, NULL, 'not-stated')) v(page, title, author, edition, isbn, role)""")
def html_citations(t: Tables) -> DataFrame:
    return _LISTS.frame(t.spark).select("page", F.explode(P.readings(F.col("html"))).alias("r")).select("page", "r.*")


_SCHEMA = {
    "type": "object", "required": ["id", "areas"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2, "maxLength": 4}, "areas": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"enum": ["law", "art"]}}, "p": {"type": ["number", "null"], "minimum": 0, "maximum": 1}, "n": {"type": "integer"},
        "v": {"const": 1}, "one": {"oneOf": [{"type": "number"}, {"type": "integer"}]}, "any": {"anyOf": [{"type": "string"}, {"type": "array", "items": {"type": "boolean"}}]}, "more": {"type": "object", "additionalProperties": {"type": "boolean"}},
    },
}
_VALUES = [
    ('{"id": "ab", "areas": ["law"]}', []), ('{"id": "a", "areas": []}', ["$.id: length", "$.areas: length"]), ('{"areas": ["law", "art", "law"]}', ["$.id: required", "$.areas: length"]), ('{"id": "ab", "areas": ["war"], "x": 1}', ["$.areas[0]: enum", "$.x: unexpected"]), ("[1]", ["$: type"]), ("{", ["$: json"]), (None, ["$: json"]),
    ('{"id": "ab", "areas": ["law"], "p": 1.5, "n": true}', ["$.p: bounds", "$.n: type"]), ('{"id": "ab", "areas": ["law"], "p": null, "n": 3, "v": 2}', ["$.v: const"]), ('{"id": "ab", "areas": ["law"], "one": 1}', ["$.one: oneOf"]), ('{"id": "ab", "areas": ["law"], "one": 1.5, "any": [true, 1]}', ["$.any: anyOf"]),
    ('{"id": "ab", "areas": ["law"], "any": "x", "more": {"y": true, "z": 0}}', ["$.more.z: type"]), ('{"id": "ab", "areas": ["law"], "p": NaN}', ["$.p: finite"]), ('{"id": 7, "areas": "law"}', ["$.id: type", "$.areas: type"]),
]
_ANSWERS = Fixture("answers", "n int, value string", tuple((i, v) for i, (v, _) in enumerate(_VALUES)))
_FAULTS = Fixture("wanted", "n int, faults array<string>", tuple((i, f) for i, (_, f) in enumerate(_VALUES)))


@query("E27", f"WITH {_FAULTS.sql} SELECT n, faults FROM wanted")
def json_rules(t: Tables) -> DataFrame:
    return _ANSWERS.frame(t.spark).select("n", P.json_faults(F.col("value"), json.loads(json.dumps(_SCHEMA))).alias("faults"))
