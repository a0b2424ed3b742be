"""Rules of a materials ledger: what a listed material is, which book it names, and what a course's evidence adds up to.

A material is a row (course_key, line, kind, title, citation, authors, edition, isbn, isbn_validation, recurrence_key,
association, eligible, excerpt, source_field, book_flag, library_titles); every rule is a column expression over it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isbn as I
from ..functions import text as T

# Wordings that state something about books and name none.
NO_RESOURCE = (
    r"^(?:there are )?no (?:(?:standard|required) )?(?:books?|text ?books?|materials?|texts?)(?: are)?(?: required| needed| to purchase| used)?(?: for this course)?(?:[;,].*)?$",
    r"^no textbook is required(?: for this course)?(?:[;,].*)?$",
    r"^no required textbooks?$",
    r"^no textbooks? are required(?: for this course)?$",
    r"^(?:text ?books?|books?|course materials?) (?:are )?not required(?: for this course)?$",
    r"^(?:text ?books?|books?|course materials?) (?:are )?not used(?: for this course)?$",
    r"^(?:this course )?(?:does not require|will not use|uses no) (?:a )?(?:standard )?(?:text ?book|book|course materials?)(?:s)?(?:[;,].*)?$",
    r"^(?:no )?(?:standard )?text ?books? (?:will be )?used(?: for this course)?$",
    r"^none(?: required)?$",
    r"^n/?a$",
    r"^tba(?: by instructor)?$|^tbd(?: by instructor)?$",
    r"^(?:to be announced|to be determined|not yet selected|not yet determined)(?: by instructor)?$",
    r"^varies(?: by section)?$",
    r"^check with instructor$",
    r"^(?:all readings will be posted|all text info is in|materials will be posted)\b",
    r"^on canvas$|^(?:course )?readings? (?:are )?on canvas$|^all readings (?:are )?on canvas$",
    r"^no required textbook,? readings? on canvas$",
    r"^readings for this course are selected by the student$",
    r"^(?:text ?book|book|course materials?|reading list) details? (?:will be|to be) provided(?: .*)?$",
    r"^(?:text ?book|book|course materials?|reading list) (?:will be|to be) announced(?: .*)?$",
)
#: All of them in one pattern, which is tried at the start alone: each begins with ``^``.
NOTHING = "^(?:" + "|".join(f"(?:{p})" for p in NO_RESOURCE) + ")"
# Wordings that no book is asked for, of places behind a login, and of what is still open.
NO_BOOK = r"\bno (?:standard |required )?(?:books?|text ?books?|materials?|texts?)\b|\bno textbook is required\b|\bnot required\b|\bnot used\b|\buses no\b|\bdoes not require\b"
BEHIND_LOGIN = r"\b(?:canvas|courseworks|lms)\b"
STILL_OPEN = r"^(?:tba|tbd|n/?a|none|varies|check with instructor|to be announced|to be determined)\b"
# Kinds of rows that are statements, kinds that are things, and titles of things.
STATEMENT_KINDS = ("textbook requirement statement", "no textbook statement", "assigned reading statement", "reading availability statement", "required reading statement")
DEVICE_KINDS = ("device", "equipment", "calculator", "classroom response device", "supplies")
DEVICE_TITLES = r"(?i)^(?:(?:ELEGOO\s+)?UNO R3 SUPER STARTER KIT|i[ -]?clicker(?:\s*(?:2|plus|\+))?(?:\s+(?:student\s+)?(?:remote|remote control|response device))?)$"
RESERVE = "library-course-reserve-candidate"
# Statuses of a course's research, in the order in which they are told apart by their wording.
STATUSES = ("found", "searched-no-public-material", "source-access-limited", "ambiguous", "not-researched", "has-saved-reference-records", "explicit-no-textbook-stated", "searched-no-book-evidence")
#: A longer title, or one of several entries, is a block that nobody has taken apart.
LONGEST_TITLE = 280


_RULED = ("kind_name", "states", "is_resource", "is_evidence", "is_book", "is_learning_book")


def any_of(text: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


def bare(title: Column) -> Column:
    """Without markup, lower-cased, white space collapsed, without punctuation at the ends."""
    return F.regexp_replace(T.plain_text(F.coalesce(title, F.lit(""))), r"^[ .;:,\-]+|[ .;:,\-]+$", "")


def text_status(said: Column, empty: Column) -> Column:
    """The status that a bare title states instead of naming a book; null where it states none. ``empty``: it matches ``NOTHING``."""
    return F.when(empty & said.rlike(NO_BOOK), "explicit-no-textbook-stated").when(said.rlike(BEHIND_LOGIN), "source-access-limited").when(empty | said.rlike(STILL_OPEN), "ambiguous")


def is_block(text: Column) -> Column:
    """Whether a title without markup is several entries in one: too long, with a blank line, numbered, or with several ISBNs."""
    numbered = F.regexp_count(text, F.lit(r"(?:^|[\r\n])\s*\d+[.)]\s+"))
    labels = F.regexp_count(text, F.lit(r"(?i)\bISBN(?:-1[03])?\b"))
    # plain searches go before patterns: few titles have what these start from
    listed = (F.contains(text, F.lit(".")) | F.contains(text, F.lit(")"))) & (numbered > 1)
    labelled = F.contains(F.lower(text), F.lit("isbn")) & ((labels > 1) | (F.size(I.labelled(text)) > 1))
    return (F.char_length(F.trim(text)) > LONGEST_TITLE) | (F.contains(text, F.lit("\n")) & text.rlike(r"\n\s*\n")) | listed | labelled


def kind_of(kind: Column) -> Column:
    return F.translate(T.plain_text(F.coalesce(kind, F.lit(""))), "_-", "  ")


def classified(materials: DataFrame) -> DataFrame:
    """``materials`` with kind_name, states (a status or null), is_resource, is_evidence, is_book, is_learning_book.

    What several rules look at is worked out once a row, in columns of its own.
    """
    kind, title = F.col("kind_name"), F.coalesce("title", F.lit(""))
    said, empty, stated, block, denies = (F.col(f"_ledger_{n}") for n in ("said", "empty", "stated", "block", "denies"))
    read = materials.withColumns({"kind_name": kind_of(F.col("kind")), "_ledger_said": bare(title), "_ledger_text": F.regexp_replace(title, r"<[^>]*>", " ")})
    read = read.withColumns({"_ledger_empty": said.rlike(NOTHING), "_ledger_denies": (kind == STATEMENT_KINDS[0]) | kind.rlike(r"\bno (?:required )?textbooks?\b"), "_ledger_block": is_block(F.col("_ledger_text"))})
    read = read.withColumn("_ledger_stated", text_status(said, empty))
    states = F.when(denies, "explicit-no-textbook-stated").otherwise(stated)
    eligible = F.coalesce("eligible", F.lit(True))
    reserved = (F.coalesce("association", F.lit("")) == RESERVE) & (kind == "book") & F.coalesce(F.exists("library_titles", lambda x: F.trim(x) == F.trim(title)), F.lit(False))
    named = eligible & ~kind.isin(*STATEMENT_KINDS) & (title != "") & ~empty
    told = stated.isNotNull() | block | title.rlike(r"(?i)^catalog description explicitly (?:states|says)\b")
    evidence = kind.isin(*STATEMENT_KINDS) | denies | (~eligible & (F.coalesce("excerpt", F.lit("")) != "")) | (F.coalesce("source_field", F.lit("")) != "") | block
    by_kind = ~kind.rlike("chapter|statement|block") & kind.rlike(r"\b(?:book|textbook|e ?book|monograph|workbook)\b")
    thing = kind.isin(*DEVICE_KINDS) | F.trim(F.split_part(title, F.lit(" / "), F.lit(1))).rlike(DEVICE_TITLES)
    made = read.withColumns({"states": states, "is_resource": named & (reserved | ~told), "is_evidence": evidence})
    made = made.withColumn("is_book", F.col("is_resource") & F.coalesce(T.flag(F.col("book_flag")), by_kind))
    made = made.withColumn("is_learning_book", F.col("is_book") & ~thing)
    return made.select(*[c for c in materials.columns if c not in _RULED], *_RULED)


def own_isbn(row: str = "") -> Column:
    """The ISBN of a material: its own if it is said to be valid, else the first valid one that a citation labels; '' if none."""
    c = lambda n: F.coalesce(F.col(f"{row}{n}"), F.lit(""))
    keyed = F.lower(c("recurrence_key")).startswith("isbn:")
    value = F.when(c("isbn") != "", c("isbn")).when(keyed, F.substring(c("recurrence_key"), 6, 1 << 20)).otherwise("")
    vouched = keyed | F.lower(c("isbn_validation")).startswith("valid") | F.contains(F.lower(c("isbn_validation")), F.lit("checksum valid"))
    cited = F.coalesce(F.get(I.labelled(F.concat_ws(" ", c("citation"), c("title"))), F.lit(0)), F.lit(""))
    return F.when((c("isbn") == "") & (c("association") == RESERVE), "").when(value == "", cited).when(vouched, I.canonical(value)).otherwise("")


def source_isbn(own: Column | None = None) -> Column:
    """Struct of raw and isbn: as a course source states it. Several different ISBNs in a citation identify none.

    ``own`` is ``own_isbn()`` where it has been worked out.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    book = lambda x: I.bound(I.canonical(x), lambda i: F.when(i.rlike("^97[89]"), i).otherwise(""))
    tokens = F.array_distinct(F.transform(F.concat(F.regexp_extract_all(c("citation"), F.lit(I.LABELLED)), F.regexp_extract_all(c("title"), F.lit(I.LABELLED))), lambda x: F.trim(x)))
    made = lambda raw, isbn: F.struct(raw.alias("raw"), isbn.alias("isbn"))
    several = lambda named: I.bound(F.array_distinct(F.transform(named, book)), lambda found: made(F.array_join(named, "; "), F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("")))
    keyed = I.bound(own_isbn() if own is None else own, lambda x: made(x, F.when(x.rlike("^97[89]"), x).otherwise("")))  # it is canonical
    cited = I.bound(tokens, lambda named: F.when(F.size(named) > 0, several(named)).otherwise(keyed))
    return F.when(c("isbn") != "", I.bound(c("isbn"), lambda x: made(x, book(x)))).otherwise(cited)


def book_identity(own: Column | None = None) -> Column:
    """Struct of key, basis: of a row of ``classified``; null where it names no resource. ``own`` as above."""
    c = lambda n: T.plain_text(F.coalesce(F.col(n), F.lit("")))
    made = lambda key, basis: F.struct(key.alias("key"), F.lit(basis).alias("basis"))

    def named(x: Column) -> Column:
        cited = made(F.concat(F.lit("citation:"), F.concat_ws("|", x["title"], x["authors"], x["edition"])), "normalized title, author, and edition")
        printed = made(F.concat(F.lit("title-edition:"), F.concat_ws("|", x["title"], x["edition"])), "normalized exact title and edition")
        return F.when(x["authors"] != "", cited).when(x["edition"] != "", printed).otherwise(made(F.concat(F.lit("title-candidate:"), x["title"]), "normalized exact title/citation"))

    spelled = I.bound(F.struct(*[c(n).alias(n) for n in ("title", "authors", "edition")]), named)
    known = lambda isbn: F.when(isbn != "", made(F.concat(F.lit("isbn:"), isbn), "checksum-valid ISBN")).otherwise(spelled)
    return F.when(F.col("is_resource"), I.bound(own_isbn() if own is None else own, known))


def research_status(value: Column) -> Column:
    """One of the known statuses, by the wording of a free one."""
    folded = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "_ ", "--")
    has = lambda *words: any_of(folded, words)
    return (
        F.when(folded.isin(*STATUSES), folded)
        .when(has("ambiguous"), "ambiguous")
        .when(has("access-limited", "login", "restricted"), "source-access-limited")
        .when(has("no-public-material", "no-material"), "searched-no-public-material")
        .when(has("found"), "found")
        .when(has("reference") & ~has("not"), "has-saved-reference-records")
        .otherwise("not-researched")
    )


def course_entries(courses: DataFrame, ledgers: DataFrame, materials: DataFrame) -> DataFrame:
    """(course_key, status, evidence_statuses, n_materials, sources, gaps): what all ledger rows of a course add up to.

    ``courses`` is (course_key, research_status, note, source_url), ``ledgers`` (course_key, status, more, source, gap),
    ``materials`` as above; equal materials of a course are one.
    """
    told = classified(materials.distinct()).groupBy("course_key").agg(F.collect_set("states").alias("texts"), F.bool_or("is_resource").alias("resources"), F.bool_or("is_evidence").alias("evidence"), F.count("*").alias("n_materials"))
    rows = ledgers.select("*", F.explode(F.concat(F.array("status"), F.coalesce("more", F.array().cast("array<string>")))).alias("one"))
    said = rows.groupBy("course_key").agg(F.array_sort(F.collect_set("one")).alias("said"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set(F.when(F.col("gap") != "", F.col("gap")))).alias("gaps"))
    both = courses.join(said, "course_key", "left").join(told, "course_key", "left")
    none = F.array().cast("array<string>")
    said, texts = F.coalesce("said", none), F.coalesce("texts", none)
    has, text = (lambda s: F.array_contains(said, s)), (lambda s: F.array_contains(texts, s))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(has("found") & yes("resources"), "found")
        .when(text("explicit-no-textbook-stated") | has("explicit-no-textbook-stated"), "explicit-no-textbook-stated")
        .when(has("source-access-limited") | text("source-access-limited"), "source-access-limited")
        .when(has("found") & yes("evidence"), "found")
        .when(has("searched-no-public-material"), "searched-no-public-material")
        .when(has("ambiguous") | text("ambiguous"), "ambiguous")
        .when(has("searched-no-book-evidence"), "searched-no-book-evidence")
        .when(has("has-saved-reference-records"), "has-saved-reference-records")
        .when(has("found"), "searched-no-public-material")
        .when(F.size(said) > 0, F.get(said, F.lit(0)))
        .otherwise(research_status(F.col("research_status")))
    )
    sources = F.when(F.size(F.coalesce("sources", none)) > 0, F.col("sources")).when(F.col("source_url").isNotNull(), F.array("source_url")).otherwise(none)
    open_ = F.lit("Per-course books and other learning materials have not been researched in this source pass.")
    gaps = F.when(F.size(F.coalesce("gaps", none)) > 0, F.col("gaps")).when(F.coalesce("note", F.lit("")) != "", F.array("note")).when(status == "not-researched", F.array(open_)).otherwise(none)
    return both.select("course_key", status.alias("status"), said.alias("evidence_statuses"), F.coalesce("n_materials", F.lit(0)).alias("n_materials"), sources.alias("sources"), gaps.alias("gaps"))


def book_matches(materials: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(course_key, line, assigned, matched, candidate, status, origin, conflict): the ISBN status of each learning book.

    ``resolutions`` is (course_key, title, isbn, confirmed). A resolution that contradicts what the course states is a conflict.
    """
    books = classified(materials).where("is_learning_book").withColumn("s", source_isbn())
    reserve = F.coalesce("association", F.lit("")) == RESERVE
    held = I.bound(I.canonical(F.col("isbn")), lambda i: F.when(i.rlike("^97[89]"), i).otherwise(""))
    both = books.join(resolutions.select("course_key", "title", F.col("isbn").alias("resolved"), "confirmed"), ["course_key", "title"], "left")
    raw, isbn, known = F.col("s.raw"), F.col("s.isbn"), F.col("resolved").isNotNull()
    own = F.when(reserve, F.when(held != "", "library-reserve-candidate").otherwise("missing")).when(isbn != "", "course-source-isbn").when(raw != "", "invalid-course-source-isbn").otherwise("missing")
    status = F.when(known & F.col("confirmed"), "publisher-edition-matched").when(known, "publisher-edition-unconfirmed").otherwise(own)
    candidate = F.when(known & ~F.col("confirmed"), F.col("resolved")).when(reserve, held).otherwise("")
    matched = F.when(known & F.col("confirmed"), F.col("resolved")).when(reserve, "").otherwise(isbn)
    origin = F.when(reserve, "library-bibliography").when(raw != "", "course-citation").otherwise("not-stated")
    conflict = known & (((raw != "") & (isbn == "")) | ((isbn != "") & (isbn != F.col("resolved"))))
    return both.select("course_key", "line", F.when(reserve, "").otherwise(isbn).alias("assigned"), matched.alias("matched"), candidate.alias("candidate"), status.alias("status"), origin.alias("origin"), conflict.alias("conflict"))


def summary(matches: DataFrame) -> DataFrame:
    """One row: the counts of a match table."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return matches.agg(
        F.count("*").alias("mappings"), F.count_distinct("course_key").alias("courses"), F.count_if(F.col("assigned") != "").alias("course_source_isbn"), is_("publisher-edition-matched").alias("publisher_matched"),
        is_("library-reserve-candidate").alias("reserve_candidates"), F.count_if(F.col("candidate") != "").alias("candidates"), is_("missing").alias("missing"), is_("invalid-course-source-isbn").alias("invalid"),
        F.count_if((F.col("assigned") == "") & (F.col("matched") == "") & (F.col("candidate") == "")).alias("without_any_isbn"), F.count_if("conflict").alias("conflicts"),
    )
