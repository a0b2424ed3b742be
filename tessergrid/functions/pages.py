"""What a result page or a reading list says, row by row; and rules that a JSON value has to keep."""

from __future__ import annotations

import json
import math
import re
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is read from a row of results.
_MD5 = re.compile(r"md5=([a-f0-9]{32})|/md5/([a-f0-9]{32})", re.I)
_YEAR, _FORMAT = re.compile(r"\b(1[5-9]\d{2}|20\d{2})\b"), re.compile(r"\b(pdf|epub|mobi|djvu|azw3|fb2)\b", re.I)
_SIZE = re.compile(r"(\d+(?:\.\d+)?\s?(?:KB|MB|GB))", re.I)
_LANGUAGE = re.compile(r"\b(English|Spanish|French|German|Russian|Chinese|Arabic|Portuguese|Italian|Dutch|Japanese|Korean|Turkish|Persian)\b", re.I)
_NO_TITLE = re.compile(r"^\d+$|^(?:libgen|mirror|\[)", re.I)


class _Rows(HTMLParser):
    """Rows of tables: the texts of their cells and links, and where the links go."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict[str, list]] = []
        self.open: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.rows.append({"td": [], "a": [], "links": []})
            self.open = []
        elif self.rows and tag in ("td", "a"):
            self.rows[-1][tag].append([])
            self.open.append((tag, self.rows[-1][tag][-1]))
        if self.rows:
            self.rows[-1]["links"] += [v for k, v in attrs if k in ("href", "src") and v]

    def handle_endtag(self, tag: str) -> None:
        if tag == "tr":
            self.open = []
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i]
                break

    def handle_data(self, data: str) -> None:
        for _, parts in self.open:
            parts.append(data)


def result_rows(html: str, limit: int) -> list[dict[str, str | None]]:
    """The first ``limit`` rows that name a file, once each: md5, title (the longest link), author, year, format, size, language."""
    reader = _Rows()
    reader.feed(html)
    reader.close()
    out: dict[str, dict] = {}
    for row in reader.rows:
        if len(out) == limit:
            break
        key = next((m for link in row["links"] if (m := _MD5.search(link))), None)
        cells = ["".join(c).strip() for c in row["td"]]
        titles = [t for t in (" ".join("".join(a).split()) for a in row["a"]) if t and not _NO_TITLE.search(t)]
        if not key or len(cells) < 3 or not titles:
            continue
        md5 = (key[1] or key[2]).lower()
        if md5 in out:
            continue
        said = " | ".join(cells)
        first = lambda pattern: (m := pattern.search(said)) and m[1]  # noqa: E731, B023
        size, kind = first(_SIZE), first(_FORMAT)
        out[md5] = {"md5": md5, "title": max(titles, key=len), "author": cells[0] if 0 < len(cells[0]) < 120 else None, "year": first(_YEAR), "format": kind and kind.upper(), "size": size and re.sub(r"\s+", " ", size), "language": first(_LANGUAGE)}
    return list(out.values())


_RESULT = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("md5", "title", "author", "year", "format", "size", "language")]))


def results(html: Column, limit: int) -> Column:
    @F.pandas_udf(_RESULT)
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: result_rows(h or "", limit))

    return read(html)


class _Entries(HTMLParser):
    """Paragraphs and list entries under headings, with what is set in italics in them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.heading, self.in_heading = "", False
        self.entries: list[dict] = []
        self.stack: list[dict] = []
        self.italics = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("h2", "h3", "h4"):
            self.heading, self.in_heading = "", True
        elif tag in ("p", "li", "td"):
            if tag == "p" and self.stack and self.stack[-1]["tag"] == "p":
                self.stack.pop()
            for outer in self.stack:
                outer["holds"] = outer["holds"] or tag in ("p", "li")
            entry = {"tag": tag, "heading": " ".join(self.heading.split()), "text": [], "titles": [], "holds": False}
            self.entries.append(entry)
            self.stack.append(entry)
        elif tag in ("em", "i") and self.stack:
            self.italics += 1
            for e in self.stack:
                e["titles"].append([])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h2", "h3", "h4"):
            self.in_heading = False
        elif tag in ("em", "i"):
            self.italics = max(0, self.italics - 1)
        else:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k]["tag"] == tag:
                    del self.stack[k:]
                    break

    def handle_data(self, data: str) -> None:
        if self.in_heading:
            self.heading += data
        for e in self.stack:
            e["text"].append(data)
            if self.italics and e["titles"]:
                e["titles"][-1].append(data)


# How a citation tells a publisher, a journal and an edition.
_PUBLISHER = re.compile(r"\b(?:press|publish(?:er|ers|ing)|wiley|springer|pearson|mcgraw|elsevier|routledge|norton|penguin|random house|harper|verlag|books)\b", re.I)
_JOURNAL = re.compile(r"\b(?:journal|review|proceedings|transactions|annals|magazine|quarterly|bulletin|letters)\b", re.I)
_EDITION = re.compile(r"\b(?:\d+(?:st|nd|rd|th)|first|second|third|fourth|fifth|revised) ed(?:ition|\.)?", re.I)
_ISBN = re.compile(r"\bISBN(?:-1[03])?\s*:?\s*([0-9Xx][0-9Xx\- ]{8,20}[0-9Xx])\b", re.I)
#: A longer paragraph is no citation.
LONGEST_CITATION = 4000


def reading_entries(html: str) -> list[dict[str, str | None]]:
    """Books that a reading list cites: an entry with one italic title that an ISBN, a publisher with a year, or an edition under
    a heading of books vouches for; quoted articles and journals are none. title, author, edition, isbn, role."""
    reader = _Entries()
    reader.feed(html)
    reader.close()
    out, seen = [], set()
    for e in reader.entries:
        citation = " ".join("".join(e["text"]).split())
        titles = list(dict.fromkeys(t for t in (" ".join("".join(x).split()).strip(" .,") for x in e["titles"]) if t))
        if e["holds"] or len(titles) != 1 or len(citation) > LONGEST_CITATION:
            continue
        title = titles[0]
        before, _, after = citation.partition(title)
        isbn, edition = _ISBN.search(citation), _EDITION.search(citation)
        author = before.strip(" ,.;:[]0123456789")
        contained = bool(re.search(r"\bIn\s*$", before))
        vouched = isbn or (_PUBLISHER.search(after) and re.search(r"\b(?:18|19|20)\d{2}\b", after)) or (re.search(r"books?\b|texts\b", e["heading"], re.I) and edition and author)
        if (_JOURNAL.search(title) and not isbn) or (re.search(r"[“\"][^”\"]+[”\"]", before) and not contained) or not vouched:
            continue
        named = author if author and not contained and len(author) <= 200 and ":" not in author and not re.search(r"\b(?:required|recommended|optional|the|of|from|readings?)\b", author, re.I) else None
        roles = {w.lower() for w in re.findall(r"\b(required|optional|recommended)\b", f"{before} {after}", re.I)} or {w.lower() for w in re.findall(r"\b(required|optional|recommended)\b", e["heading"], re.I)}
        item = {"title": title, "author": named, "edition": edition[0] if edition else None, "isbn": isbn[1].strip() if isbn else None, "role": roles.pop() if len(roles) == 1 and not re.search(r"\bnot\b", citation) else "not-stated"}
        key = (title.casefold(), item["isbn"], (named or "").casefold(), (item["edition"] or "").casefold(), item["role"])
        if key not in seen:
            seen.add(key)
            out.append(item)
    return out


_READING = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "author", "edition", "isbn", "role")]))


@F.pandas_udf(_READING)
def readings(html: pd.Series) -> pd.Series:
    return html.map(lambda h: reading_entries(h or ""))


_KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def faults(value: Any, schema: dict, at: str = "$") -> list[str]:
    """Where a JSON value breaks a schema, as path: rule, in document order; alternatives report as a whole."""
    out = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if isinstance(value, float) and not math.isfinite(value):
        return [f"{at}: finite"]
    if kinds and not any(_KINDS[k](value) for k in kinds):
        return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: const")
    for union, fits in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if union in schema and not fits(sum(not faults(value, option, at) for option in schema[union])):
            out.append(f"{at}: {union}")
    if isinstance(value, dict):
        own, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in own:
                out += faults(v, own[k], f"{at}.{k}")
            elif other is False:
                out.append(f"{at}.{k}: unexpected")
            elif isinstance(other, dict):
                out += faults(v, other, f"{at}.{k}")
    sized = "Items" if isinstance(value, list) else "Length" if isinstance(value, str) else None
    if sized and not schema.get(f"min{sized}", 0) <= len(value) <= schema.get(f"max{sized}", math.inf):
        out.append(f"{at}: length")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += faults(v, schema["items"], f"{at}[{i}]")
    if _KINDS["number"](value) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        out.append(f"{at}: bounds")
    return out


def json_faults(value: Column, schema: dict) -> Column:
    """Faults of a column of JSON texts; a text that is no JSON has the one fault ``$: json``."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def check(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            try:
                return faults(json.loads(t or ""), schema)
            except ValueError:
                return ["$: json"]

        return texts.map(one)

    return check(value)
