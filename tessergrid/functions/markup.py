"""Structure of HTML and Markdown documents: text, headings with offsets, images, citations."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements at whose start, and at whose end, a line breaks; headings do both.
_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
_STARTS = ("p", "div", "br", "li", "tr", "section", "figure", *_HEADS)
_ENDS = ("p", "div", "li", "tr", "section", "figure", "figcaption", *_HEADS)
_SILENT = frozenset(("script", "style"))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.size = 0
        self.silent = 0
        self.math = 0
        self.open: tuple[int, int, int] | None = None
        self.headings: list[dict] = []
        self.images: list[dict] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
            return
        self.math += tag == "math" and not self.silent
        if self.math and not self.silent:
            self.add(self.get_starttag_text() or "")
        elif tag == "img" and not self.silent:
            found = dict(attrs)
            self.images.append({"src": found.get("src") or "", "alt": found.get("alt") or "", "offset": self.size})
            self.add(found.get("alt") or "")
        elif tag in _STARTS and not self.silent:
            self.add("\n")
            if tag in _HEADS:
                self.open = (int(tag[1]), self.size, len(self.parts))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.math and not self.silent:
            self.add(f"</{tag}>")
            self.math -= tag == "math"
        elif tag in _ENDS and not self.silent:
            if self.open and tag in _HEADS:
                title = "".join(self.parts[self.open[2] :]).strip()
                self.headings.append({"level": self.open[0], "title": title, "offset": self.open[1]})
                self.open = None
            self.add("\n")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.add(data)


_INT, _TEXT = T.IntegerType(), T.StringType()
HEADINGS = T.ArrayType(T.StructType([T.StructField("level", _INT), T.StructField("title", _TEXT), T.StructField("offset", _INT)]))
IMAGES = T.ArrayType(T.StructType([T.StructField("src", _TEXT), T.StructField("alt", _TEXT), T.StructField("offset", _INT)]))
STRUCTURE = T.StructType([T.StructField("text", _TEXT), T.StructField("headings", HEADINGS), T.StructField("images", IMAGES)])


@F.pandas_udf(STRUCTURE)
def html_structure(html: pd.Series) -> pd.DataFrame:
    """Text with line breaks at blocks, headings and images with their places in that text; formulas keep their markup."""

    def one(h: str | None) -> tuple:
        reader = _Reader()
        reader.feed(h or "")
        reader.close()
        return "".join(reader.parts), reader.headings, reader.images

    return pd.DataFrame([one(h) for h in html], columns=["text", "headings", "images"])


_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*$", re.M)


@F.pandas_udf(HEADINGS)
def markdown_headings(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"level": len(m[1]), "title": m[2].strip(), "offset": m.start()} for m in _HEADING.finditer(t or "")])


# First bytes of file formats, in hexadecimal, and where they stand.
MAGIC = {"pdf": ("255044462D", 1), "djvu": ("41542654464F524D", 1), "mobi": ("424F4F4B4D4F4249", 61), "epub": ("504B0304", 1)}


def file_format(content):
    """Format of a binary column by its magic bytes."""
    out = F.lit("unknown")
    for name, (magic, at) in reversed(list(MAGIC.items())):
        out = F.when(F.hex(F.substring(content, at, len(magic) // 2)) == magic, F.lit(name)).otherwise(out)
    return out
