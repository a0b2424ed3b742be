"""Identity keys and citation parts as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ordinal words of editions, in order.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC and case folding, white space collapsed: neither exists as a built-in."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def resource_identity(isbn: Column, title: Column, author: Column, edition: Column) -> Column:
    """Struct of key, basis: by ISBN, else title and author, else title and edition, else title; null without a title."""
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    t, a, e = (squeezed(F.coalesce(c, F.lit(""))) for c in (title, author, edition))
    made = lambda key, basis: F.struct(key.alias("key"), F.lit(basis).alias("basis"))
    return (
        F.when(~has(title), F.lit(None))
        .when(has(isbn), made(F.concat(F.lit("isbn:"), isbn), "isbn"))
        .when(has(author), made(F.concat(F.lit("citation:"), F.concat_ws("|", t, a, e)), "title-author-edition"))
        .when(has(edition), made(F.concat(F.lit("title-edition:"), F.concat_ws("|", t, e)), "title-edition"))
        .otherwise(made(F.concat(F.lit("title-candidate:"), t), "title"))
    )


def course_identity(school: Column, code: Column, key: Column, prefixes: str = "MIT|CMU") -> Column:
    """School and the code before a slash, without a known prefix and white space; without a code, the key."""
    first = F.trim(F.split_part(F.coalesce(code, F.lit("")), F.lit("/"), F.lit(1)))
    plain = F.regexp_replace(F.lower(F.regexp_replace(first, rf"(?i)^(?:{prefixes})\s+", "")), r"\s+", "")
    none = (first == "") | squeezed(first).isin("n/a", "unknown", "no code listed")
    return F.when(none, F.concat(F.lit("course-key:"), key)).otherwise(F.concat(squeezed(school), F.lit("|"), plain))


def edition_number(text: Column) -> Column:
    """Number of an edition, from digits or an ordinal word."""
    low = F.lower(text)
    word = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(ORDINALS, 1))):
        word = F.when(low.rlike(rf"\b{name}\b"), F.lit(str(i))).otherwise(word)
    digits = F.regexp_extract(low, r"([0-9]+)", 1)
    return F.when(digits != "", digits).otherwise(F.coalesce(word, low))


def surnames(authors: Column) -> Column:
    """Sorted surnames of a list split at ; & or "and": before a comma, else the last word."""
    names = F.filter(F.transform(F.split(authors, r"(?i)\s*(?:;|&|\band\b)\s*"), lambda n: F.trim(n)), lambda n: n != "")
    last = lambda n: F.lower(F.when(n.contains(","), F.split_part(n, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(n, r"\s+"), -1)))
    return F.array_sort(F.array_distinct(F.transform(names, last)))


def public_url(url: Column) -> Column:
    """http or https with a host, no user and no query key that looks like a secret."""
    sound = url.rlike(r"^https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#]|$)")
    secret = url.rlike(r"(?i)[?&](?:token|key|api_key|apikey|signature|sig|secret|password|auth|session)=")
    return F.coalesce(sound & ~secret, F.lit(False))
