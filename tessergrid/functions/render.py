"""Rows as lines of HTML and Markdown: every value escaped, links only where they are public."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.identities import public_link


def escaped(value: Column) -> Column:
    """Text that HTML shows as it is."""
    out = F.coalesce(value, F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def html_link(text: Column, url: Column) -> Column:
    shown = escaped(text)
    return F.when(public_link(url), F.concat(F.lit('<a href="'), escaped(url), F.lit('" rel="noreferrer">'), shown, F.lit("</a>"))).otherwise(shown)


def markdown_text(value: Column) -> Column:
    """Text that Markdown shows as it is, on one line."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), r"([\\`*_{}\[\]()#+\-.!|<>])", r"\\$1")


def markdown_link(text: Column, url: Column) -> Column:
    shown = markdown_text(text)
    return F.when(public_link(url), F.concat(F.lit("["), shown, F.lit("]("), F.regexp_replace(url, r"[()\s]", ""), F.lit(")"))).otherwise(shown)
