"""Identities of courses, books and people, and what counts as evidence for them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import isbn as I
from ..functions import text as T
from ..functions.identity import stable_id

# What stands for nothing known.
UNKNOWN = ("", "unknown", "n/a", "na", "not stated", "no code listed", "unresolved")
# Ordinal words of editions, in order.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth")
# Names of institutions and the ids that they resolve to.
INSTITUTIONS = {
    "berkeley": ("University of California, Berkeley", "Berkeley", "UC Berkeley", "University of California Berkeley"),
    "brown": ("Brown University", "Brown"),
    "carnegie-mellon": ("Carnegie Mellon University", "Carnegie Mellon", "CMU"),
    "columbia": ("Columbia University", "Columbia"),
    "cornell": ("Cornell University", "Cornell"),
    "dartmouth": ("Dartmouth College", "Dartmouth"),
    "harvard": ("Harvard University", "Harvard"),
    "mit": ("Massachusetts Institute of Technology", "MIT"),
    "penn": ("University of Pennsylvania", "Penn", "UPenn"),
    "princeton": ("Princeton University", "Princeton"),
    "stanford": ("Stanford University", "Stanford"),
    "yale": ("Yale University", "Yale"),
}
# Course codes of two institutions, whole.
CODES = {"mit": r"^(?:mit\s+)?(\d+[a-z]*\.[a-z]*\d+[a-z0-9]*)$", "carnegie-mellon": r"^(?:cmu\s+)?(\d{2})[- ]?(\d{3}[a-z]?)$"}
# Words of roles, and words that deny one.
ROLE_WORDING = {"required": r"\brequired\b", "optional": r"\boptional\b", "recommended": r"\b(?:recommended|recommendations?|suggested)\b"}
DENIAL = r"\b(?:not|never|no|none|(?:isn|aren|wasn|weren|don|doesn|didn|won|wouldn|shouldn|couldn|mustn|needn)\s+t)\b"



def words(value: Column) -> Column:
    return F.regexp_extract_all(T.plain_text(F.coalesce(value, F.lit(""))), F.lit(r"(?U)(\w+)"))


def plain(value: Column) -> Column:
    """The words of a text, without markup, case and punctuation, one blank between."""
    return F.array_join(words(value), " ")


def squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))


def institution(name: Column) -> Column:
    """The id of an institution by any of its names, else one made of the name."""
    folded = F.trim(F.regexp_replace(F.lower(name), r"(?U)[^\w]+", " "))
    spelled = {T_fold(a): key for key, names in INSTITUTIONS.items() for a in (key, *names)}
    known = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    weill = folded.isin("weill cornell medicine", "weill cornell medical college")
    return F.when(weill, "cornell").otherwise(F.coalesce(F.element_at(known, folded), F.concat(F.lit("external:"), F.substring(F.sha2(folded, 256), 1, 24))))


def T_fold(name: str) -> str:
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in name.casefold()).split())


def course_code(code: Column, university: Column) -> Column:
    """A code as its university writes it, without a prefix and with one separator; others only squeezed."""
    raw = squeezed(code)
    cmu = F.concat_ws("-", F.regexp_extract(raw, CODES["carnegie-mellon"], 1), F.regexp_extract(raw, CODES["carnegie-mellon"], 2))
    return F.when((university == "mit") & raw.rlike(CODES["mit"]), F.regexp_extract(raw, CODES["mit"], 1)).when((university == "carnegie-mellon") & raw.rlike(CODES["carnegie-mellon"]), cmu).otherwise(raw)


def course_key(university: Column, code: Column, title: Column, school: Column, key: Column) -> Column:
    """Five parts: university, code, title, school without the university's own name, and the record's key where code or title is unknown."""
    uid = institution(university)
    own = F.when(institution(F.coalesce(school, F.lit("?"))) == uid, "").otherwise(squeezed(school))
    unknown = course_code(code, uid).isin(*UNKNOWN) | squeezed(title).isin(*UNKNOWN)
    return F.struct(uid.alias("university"), course_code(code, uid).alias("code"), squeezed(title).alias("title"), own.alias("school"), F.when(unknown, key).otherwise("").alias("fallback"))


def edition(value: Column) -> Column:
    """The number of an edition, from digits or an ordinal; what it says where it has none."""
    said = F.trim(F.regexp_replace(plain(value), r"\b(?:edition|ed)\b", ""))
    ordinals = F.create_map(*[F.lit(x) for i, word in enumerate(ORDINALS, 1) for x in (word, str(i))])
    number = lambda x: F.when(x.rlike(r"^\d+(?:st|nd|rd|th)?$"), F.regexp_extract(x, r"^(\d+)", 1)).otherwise(F.coalesce(F.try_element_at(ordinals, x), x))
    # bound by a lambda, since a text that is asked for by name is worked out anew for every question
    return F.get(F.transform(F.array(said), number), 0)


def surnames(value: Column) -> Column:
    """Sorted last words of the people of a list; one-letter words and titles are none."""
    people = F.split(F.coalesce(value, F.lit("")), r"(?i)[,;&/]|\band\b")
    named = F.transform(people, lambda p: F.filter(words(p), lambda w: (F.char_length(w) > 1) & ~w.isin("et", "al", "jr", "editor", "editors")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(named, lambda w: F.size(w) > 0), lambda w: F.element_at(w, -1))))


def same_person(assigned: Column, returned: Column) -> Column:
    """Whether any assigned name is any returned one: equal words, or an equal family name and given names that agree up to initials."""

    def agree(a: Column, r: Column) -> Column:
        all_, other = words(a), words(r)
        comma = a.contains(",")
        family = F.when(comma, words(F.split_part(a, F.lit(","), F.lit(1)))).otherwise(F.slice(all_, -1, 1))
        given = F.when(comma, words(F.regexp_replace(a, r"^[^,]*,", ""))).otherwise(F.slice(all_, F.lit(1), F.greatest(F.size(all_) - 1, F.lit(0))))
        n = F.size(other) - F.size(family)
        rest = F.slice(other, F.lit(1), F.greatest(n, F.lit(0)))
        tail = F.slice(other, F.greatest(n, F.lit(0)) + 1, F.size(family))
        short = lambda x, y: (F.char_length(x) == 1) & y.startswith(x)
        alike = F.forall(F.zip_with(given, rest, lambda x, y: (x == y) | short(x, y) | short(y, x)), lambda ok: F.coalesce(ok, F.lit(False)))
        return (F.size(all_) > 0) & ((all_ == other) | ((F.size(given) > 0) & (n > 0) & (tail == family) & (F.size(given) == F.size(rest)) & alike))

    return F.exists(assigned, lambda a: F.exists(returned, lambda r: agree(a, r)))


def display_title(title: Column, authors: Column, isbn: Column, origin: Column) -> Column:
    """A title without the authors and the ISBN that a listing hangs on it, if they are those of the row."""
    parts = F.split(title, " / ")
    n = F.size(parts)
    tail = F.regexp_extract(F.trim(F.element_at(parts, -1)), r"(?i)^ISBN(?:-1[03])?\s*:?\s*([0-9Xx][0-9Xx\- ]{8,20}[0-9Xx])$", 1)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), " / ")
    hung = (n >= 3) & (F.coalesce(isbn, F.lit("")) != "") & (F.coalesce(origin, F.lit("")) != "library-bibliography") & ~squeezed(authors).isin(*UNKNOWN) & (squeezed(F.get(parts, n - 2)) == squeezed(authors)) & (I.canonical(tail) == isbn) & (F.trim(head) != "")
    return F.when(F.coalesce(hung, F.lit(False)), F.trim(head)).otherwise(title)


def book_key(row: dict[str, Column]) -> Column:
    """Six parts: ISBN, title, authors, edition, what tells unresolved citations apart, and whether the ISBN is unconfirmed."""
    isbn = F.when(F.coalesce(row["matched"], F.lit("")) != "", row["matched"]).otherwise(F.coalesce(row["candidate"], F.lit("")))
    known = lambda c: F.when(squeezed(c).isin(*UNKNOWN), "").otherwise(squeezed(c))
    authors, ed = known(row["authors"]), F.when(squeezed(row["edition"]).isin(*UNKNOWN), "").otherwise(edition(row["edition"]))
    open_ = (authors == "") | ((isbn == "") & (ed == "")) | (row["status"] == "invalid-course-source-isbn")
    apart = F.when(open_, F.concat_ws("|", squeezed(row["citation"]), F.coalesce(row["raw"], F.lit("")), row["origin"], row["status"])).otherwise("")
    title = squeezed(display_title(row["title"], row["authors"], row["assigned"], row["origin"]))
    kind = F.when(row["status"] == "publisher-edition-unconfirmed", row["status"]).otherwise("")
    return F.struct(isbn.alias("isbn"), title.alias("title"), authors.alias("authors"), ed.alias("edition"), apart.alias("unresolved"), kind.alias("kind"))


def reading_role(value: Column) -> Column:
    said = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return (
        F.when(said.rlike(r"not stated|not-stated|unconfirmed|not required|unknown"), "not stated")
        .when(said.rlike(r"^(?:optional|suggested|supplementary|supplemental|reference|recommended)\b"), "optional/reference")
        .when(said.rlike(r"^required\b"), "required")
        .otherwise("not stated")
    )


def supported(value: Column, citation: Column) -> Column:
    """Whether the words of a value stand in a citation, one after the other."""
    return (plain(value) != "") & F.concat(F.lit(" "), plain(citation), F.lit(" ")).contains(F.concat(F.lit(" "), plain(value), F.lit(" ")))


def affirmed(role: str, evidence: Column, source: Column) -> Column:
    """Whether a source says the evidence for a role in a clause that does not deny it first.

    Denial in front of the first place of the evidence denies all later ones, so only the first of each clause is looked at.
    """
    wording = ROLE_WORDING[role]
    said = plain(evidence)
    lead = F.regexp_extract(said, rf"^(.*?){wording}", 1)

    def holds(clause: Column) -> Column:
        padded = F.concat(F.lit(" "), plain(clause), F.lit(" "))
        at = F.call_function("locate", F.concat(F.lit(" "), said, F.lit(" ")), padded)
        return (at > 0) & ~F.concat(F.substring(padded, F.lit(1), at), lead).rlike(DENIAL)

    clauses = F.split(source, r"(?i)[.!?;\n]|\b(?:but|however)\b")
    return F.coalesce((said != "") & said.rlike(wording) & F.exists(clauses, holds), F.lit(False))


def code_aliases(value: Column) -> Column:
    """The codes that a slash-separated listing stands for: a bare number takes the letters of the first code."""
    pieces = F.transform(F.split(value, "/"), lambda p: F.trim(p))
    prefix = F.regexp_extract(F.get(pieces, F.lit(0)), r"^(.*\D)\d+\w*$", 1)
    full = F.transform(pieces, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(prefix, p)).otherwise(p))
    return F.array_sort(F.array_distinct(F.transform(full, lambda p: F.lower(F.regexp_replace(p, r"(?U)\W", "")))))


def years(value: Column) -> Column:
    """The years that a version names, the second of a range such as 2024-25 too."""
    whole = F.regexp_extract_all(value, F.lit(r"\b((?:19|20)\d{2})\b"))
    ranges = F.transform(F.regexp_extract_all(value, F.lit(r"\b((?:19|20)\d{2}-\d{2})\b")), lambda r: F.concat(F.substring(r, 1, 2), F.substring(r, 6, 2)))
    return F.array_sort(F.array_distinct(F.concat(whole, ranges)))


def versions_agree(expected: Column, quoted: Column) -> Column:
    """Whether a quoted version shares a year with the expected one and names no other term."""
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\b((?:fall|spring|summer|winter|autumn)\s+(?:19|20)\d{2})\b"))
    named = F.transform(F.regexp_extract_all(quoted, F.lit(r"\b((?:19|20)\d{2})\b")), lambda y: y)
    fits = (F.size(terms(expected)) == 0) | ((F.size(terms(quoted)) > 0) & (F.size(F.array_except(terms(quoted), terms(expected))) == 0))
    return F.arrays_overlap(years(expected), named) & fits


def merged_results(found: DataFrame, wanted: str) -> DataFrame:
    """(md5, title, author, year, format, isbns, n_sources, isbn_match): results of several sources as one list.

    ``found`` is (source_order, md5, title, author, year, format, isbns). Of rows with one md5 the first non-empty field
    counts, the longest title and all ISBNs; rows without an md5 stay apart. ``isbn_match`` is held against ``wanted``.
    """
    filled = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("source_order"))).alias(c)
    alone = F.when(F.coalesce("md5", F.lit("")) == "", F.monotonically_increasing_id())
    listed = F.transform(F.array_sort(F.collect_list(F.struct("source_order", F.coalesce("isbns", F.array().cast("array<string>")).alias("isbns")))), lambda x: x["isbns"])
    merged = found.withColumn("alone", alone).groupBy("md5", "alone").agg(F.max_by("title", F.struct(F.char_length(F.coalesce("title", F.lit(""))).alias("n"), (-F.col("source_order")).alias("o"))).alias("title"), *[filled(c) for c in ("author", "year", "format")], F.array_distinct(F.flatten(listed)).alias("isbns"), F.count("*").alias("n_sources"))
    known = F.filter(F.transform("isbns", I.canonical), lambda x: x != "")
    match = F.when(F.array_contains(known, wanted), "verified").when(F.size(known) > 0, "different").otherwise("unverified")
    return merged.withColumn("isbn_match", match).drop("alone")


def verified(merged: DataFrame) -> DataFrame:
    """Results that name the wanted ISBN under an md5 that is one, once each."""
    return merged.where((F.col("isbn_match") == "verified") & F.lower("md5").rlike("^[a-f0-9]{32}$")).dropDuplicates(["md5"])


def decoded_rows(rows: DataFrame, columns: list[str], coded: dict[str, dict[int, str]]) -> DataFrame:
    """(set_id, ord, *columns): rows of a compressed table spelled out.

    ``rows`` is (set_id, ord, repeats, nulls, cells): bit i of ``repeats`` says that column i is as in the row before, of
    ``nulls`` that it is null; cells hold the others in order, as indices where a column is ``coded``.
    """
    bit = lambda c, i: F.col(c).bitwiseAND(F.lit(1 << i)) != 0
    given = [~bit("repeats", i) & ~bit("nulls", i) for i in range(len(columns))]
    before = Window.partitionBy("set_id").orderBy("ord")
    out = []
    for i, name in enumerate(columns):
        place = sum((g.cast("int") for g in given[:i]), F.lit(0))
        cell = F.get("cells", place)
        if name in coded:
            cell = F.element_at(F.create_map(*[F.lit(x) for pair in coded[name].items() for x in pair]), cell.try_cast("int"))
        fresh = F.when(~bit("repeats", i), F.struct(F.when(given[i], cell).alias("v")))
        out.append(F.last(fresh, ignorenulls=True).over(before)["v"].alias(name))
    return rows.select("set_id", "ord", *out)


def faulty_sets(rows: DataFrame) -> DataFrame:
    """Sets whose first row repeats a cell: there is nothing to repeat."""
    first = rows.groupBy("set_id").agg(F.min_by("repeats", "ord").alias("r"))
    return first.where("r <> 0").select("set_id")


def same_identity(expected: DataFrame, seen: DataFrame, fields: list[str]) -> DataFrame:
    """(key, same): whether the sets of values of all fields are equal. Both are long, (key, field, value); case and blanks do not count."""
    told = lambda df, n: df.where(F.col("field").isin(fields) & (F.coalesce(F.trim("value"), F.lit("")) != "")).groupBy("key", "field").agg(F.array_sort(F.collect_set(squeezed(F.col("value")))).alias(n))
    both = told(expected, "a").join(told(seen, "b"), ["key", "field"], "full_outer")
    return both.groupBy("key").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("same"))


__all__ = ["affirmed", "book_key", "code_aliases", "course_code", "course_key", "decoded_rows", "display_title", "edition", "faulty_sets", "institution", "merged_results", "plain", "reading_role", "same_identity", "same_person", "stable_id", "supported", "surnames", "verified", "versions_agree", "words", "years"]


def public_link(url: Column) -> Column:
    """http or https with a host, no user, and no query key that looks like a secret's."""
    sound = url.rlike(r"^(?i:https?)://[^/?#@\s]+(?:[/?#]|$)") & ~url.rlike(r"^[^:]+:///")
    secret = url.rlike(r"(?i)\?(?:[^#]*&)?[^=&#]*(?:token|password|secret|credential|signature|api.?key)[^=&#]*=[^&#]")
    return F.coalesce(sound & ~secret, F.lit(False))


def bare_code(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s-]", ""))


def code_supported(value: Column, excerpt: Column) -> Column:
    """Whether an excerpt has a code by itself, however it spaces it."""
    signs = F.filter(F.split(bare_code(value), ""), lambda c: c != "")
    spaced = F.array_join(F.transform(signs, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), r"[\s-]*")
    pattern = F.concat(F.lit(r"(?i)(?<![\w.])"), spaced, F.lit(r"(?:(?![\w.])|(?=\.\s))"))
    return (F.size(signs) > 0) & F.coalesce(F.rlike(excerpt, pattern), F.lit(False))


#: Bases on which a course of a source is one of the catalogue, and what each asks for.
BASES = ("exact-code-and-title", "official-code-with-title-variant", "official-renumbering", "official-code-alias", "official-yale-term-suffix")


def basis_fault(r: dict[str, Column]) -> Column:
    """Why a match of a source's course with a catalogue's does not hold on the basis it claims; null where it does.

    ``r`` has basis, university, source_code, source_title, code, title, rationale and excerpt.
    """
    same_code, same_title = bare_code(r["code"]) == bare_code(r["source_code"]), plain(r["title"]) == plain(r["source_title"])
    no_reason = F.coalesce(F.trim(r["rationale"]), F.lit("")) == ""
    both = code_supported(r["code"], r["excerpt"]) & code_supported(r["source_code"], r["excerpt"])
    suffix = (r["university"] == "yale") & bare_code(r["source_code"]).rlike(r"^[a-z]{2,}\d{4}$") & bare_code(r["code"]).isin(F.concat(bare_code(r["source_code"]), F.lit("a")), F.concat(bare_code(r["source_code"]), F.lit("b")))
    named = code_supported(r["code"], r["excerpt"]) & supported(r["title"], r["excerpt"])
    basis = F.coalesce(r["basis"], F.lit(BASES[0]))
    return (
        F.when(~basis.isin(*BASES), "unknown basis")
        .when(basis == BASES[4], F.when(~suffix, "no term suffix").when(no_reason, "no rationale").when(~named, "not in the official catalogue"))
        .when(basis.isin(*BASES[2:4]), F.when(no_reason, "no rationale").when(~both, "excerpt lacks a code"))
        .when(~same_code, "codes differ")
        .when(basis == BASES[0], F.when(~same_title, "titles differ"))
        .when(no_reason, "no rationale")
    )


def harvested_urls(payload: Column) -> Column:
    """Sorted http(s) URLs of a JSON text, at any depth, under keys that say url."""
    keyed = F.regexp_extract_all(F.coalesce(payload, F.lit("")), F.lit(r'"[^"]*url[^"]*"\s*:\s*(\[[^\]]*\]|"[^"]*")'))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(keyed, lambda v: F.regexp_extract_all(v, F.lit(r'"(https?://[^"/?#\s][^"]*)"'))))))
