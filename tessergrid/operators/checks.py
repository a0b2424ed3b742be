"""What has to hold before something is used: reviews, evidence, files, filters; and what is still to be indexed or asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import isbn as I
from ..functions import text as T
from .classify import byte_batches
from .identities import institution, plain, public_link

# Formats of documents, checks that a file must have passed, bases of an ISBN that confirm nothing.
FORMATS, FILE_CHECKS = ("pdf", "epub", "mobi", "djvu"), ("catalog-md5", "supported-format", "sha256-stability")
UNCONFIRMED = ("library-title-only-candidate", "library-work-only-candidate")
TAG_ID = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
#: Seconds for which a found and an empty result are kept, and for which a failing mirror is left alone.
KEEP_FOUND, KEEP_EMPTY, COOLDOWN = 300, 30, 30


def blank(c: Column | str) -> Column:
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def review_faults(records: DataFrame, reviews: DataFrame, areas: list[str]) -> DataFrame:
    """(course_key, fault): null where a review fits the record it was written for.

    ``records`` is (course_key, source_fingerprint, classification_fingerprint, status, urls, texts), ``reviews`` (course_key,
    source_fingerprint, classification_fingerprint, reviewer, rationale, evidence array<struct<url,quote>>, area_ids, primary).
    """
    now = records.select("course_key", F.col("source_fingerprint").alias("s"), F.col("classification_fingerprint").alias("c"), "status", "urls", "texts")
    both = reviews.join(now, "course_key", "left")
    sourced = F.forall("evidence", lambda e: F.array_contains("urls", e["url"]))
    quoted = F.forall("evidence", lambda e: (plain(e["quote"]) != "") & F.exists("texts", lambda t: F.contains(plain(t), plain(e["quote"]))))
    allowed = F.array(*[F.lit(a) for a in areas])
    fault = (
        F.when(F.col("s").isNull(), "unknown course")
        .when(F.col("status") == "reviewed", "already reviewed")
        .when((F.col("s") != F.col("source_fingerprint")) | (F.col("c") != F.col("classification_fingerprint")), "stale")
        .when(blank("reviewer") | blank("rationale"), "unsigned")
        .when(F.size(F.coalesce("evidence", F.array())) == 0, "no evidence")
        .when(~sourced, "foreign source")
        .when(~quoted, "quote not in course")
        .when((F.size("area_ids") != F.size(F.array_distinct("area_ids"))) | (F.size(F.array_except("area_ids", allowed)) > 0), "repeated or unknown areas")
        .when(~F.coalesce(F.array_contains("area_ids", F.col("primary")), F.lit(False)), "primary not among areas")
    )
    return both.select("course_key", fault.alias("fault"))


def compact_tags(tags: Column) -> Column:
    """Of an array of structs with id, label and anchors (kind, quote): sound ones, cut to id, label and sound anchors."""
    sound = lambda t: (F.char_length(t["id"]) <= 100) & t["id"].rlike(TAG_ID) & F.char_length(t["label"]).between(1, 200)
    anchors = lambda t: F.filter(F.coalesce(t["anchors"], F.array().cast("array<struct<kind:string,quote:string>>")), lambda a: a["kind"].isin("course", "reading") & (F.char_length(a["quote"]) <= 2000))
    return F.transform(F.filter(tags, lambda t: F.coalesce(sound(t), F.lit(False))), lambda t: F.struct(t["id"].alias("id"), t["label"].alias("label"), anchors(t).alias("anchors")))


def course_evidence(courses: DataFrame, materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(course_key, fault) of courses, and materials of sound ones with what they take over from their course.

    ``courses`` is (course_key, evidence_id, institution, code, title, source_year, source_url, verification), ``materials``
    (course_key, line, kind, title, exact_title, role, source_year, verification).
    """
    twice = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    missing = [blank(c) for c in ("course_key", "evidence_id", "institution", "code", "title", "source_year")]
    empty = missing[0]
    for m in missing[1:]:
        empty = empty | m
    books = materials.groupBy("course_key").agg(F.bool_and((F.col("kind") == "book") & ~blank("title")).alias("books"), F.bool_and(F.coalesce(F.col("exact_title") == F.col("title"), F.lit(True))).alias("exact"), F.bool_and(F.col("role").isin("required", "optional", "recommended", "not-stated")).alias("roles"))
    seen = courses.withColumns({"twice": twice("course_key") | twice("evidence_id")}).join(books, "course_key", "left")
    fault = (
        F.when(empty, "incomplete")
        .when(F.col("twice"), "repeated")
        .when(institution(F.col("institution")).startswith("external:"), "out of scope")
        .when(~public_link(F.col("source_url")), "no public source")
        .when(F.col("verification") != "reviewed-primary-source", "not reviewed")
        .when(F.col("books").isNull(), "no materials")
        .when(~F.col("books"), "not a named book")
        .when(~F.col("exact"), "titles differ")
        .when(~F.col("roles"), "unknown role")
    )
    judged = seen.withColumn("fault", fault)
    own = judged.where("fault is null").select("course_key", F.col("source_year").alias("year"), F.col("verification").alias("v"))
    told = materials.join(own, "course_key").select("course_key", "line", "title", F.coalesce("exact_title", "title").alias("exact_title"), F.coalesce("source_year", "year").alias("source_year"), F.coalesce("verification", "v").alias("verification"))
    return judged.select("course_key", "fault"), told


def search_plan(materials: DataFrame) -> DataFrame:
    """(book, title, isbns, status): the ISBNs to ask for, book by book; those that confirm nothing are not asked.

    ``materials`` is (book, title, isbn, findings array<struct<isbn,basis>>).
    """
    sure = F.filter(F.coalesce("findings", F.array().cast("array<struct<isbn:string,basis:string>>")), lambda f: ~blank(f["basis"]) & ~f["basis"].isin(*UNCONFIRMED))
    every = F.array_distinct(F.filter(F.concat(F.array(I.canonical(F.col("isbn"))), F.transform(sure, lambda f: I.canonical(f["isbn"]))), lambda x: x != ""))
    return materials.select("book", "title", every.alias("isbns")).withColumn("status", F.when(F.size("isbns") > 0, "ready").otherwise("no-supported-isbn"))


def file_faults(records: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(path, fault) of results that claim a checked file; results without one are left out.

    ``records`` is (path, status, isbn_match, format, sha256, md5, bytes, checks, checked_at), ``files`` (path, content).
    """
    claimed = records.where((F.col("status") == "file_verified") & (F.col("isbn_match") == "verified"))
    found = files.select("path", F.sha2("content", 256).alias("s"), F.md5("content").alias("m"), F.octet_length("content").alias("n"))
    both = claimed.join(found, "path", "left")
    checks = F.array(*[F.lit(c) for c in FILE_CHECKS])
    fault = (
        F.when(~F.col("path").startswith(f"{folder}/") | F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)"), "outside the selection")
        .when(F.col("s").isNull(), "no file")
        .when(~F.col("format").isin(*FORMATS), "unsupported format")
        .when((F.col("n") == 0) | (F.col("s") != F.col("sha256")) | (F.col("m") != F.col("md5")) | (F.col("n") != F.col("bytes")), "changed")
        .when((F.size(F.array_except(checks, F.coalesce("checks", F.array().cast("array<string>")))) > 0) | blank("checked_at"), "unchecked")
    )
    return both.select("path", fault.alias("fault"))


def index_plan(units: DataFrame, vectors: DataFrame, covered: DataFrame, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left to embed: (unit, batch) of pending units by source, vectors to delete (unit), and (parent, done, total, status).

    ``units`` is (source, parent, unit, fingerprint, bytes), ``vectors`` (unit, fingerprint), ``covered`` (parent, unit): the units
    that a parent had when it was last indexed. A vector of another fingerprint does not count.
    """
    current = units.join(vectors, ["unit", "fingerprint"], "left_semi").select("unit").withColumn("has", F.lit(True))
    marked = units.join(current, "unit", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    pending = byte_batches(marked.where(~F.col("has")), ["source"], "unit", F.col("bytes"), most_bytes, most_rows).select("source", "unit", F.col("batch").cast("int").alias("batch"))
    known = covered.join(units.select("parent").distinct(), "parent", "left_semi")
    stale = known.join(units.select("unit"), "unit", "left_anti").join(vectors.select("unit"), "unit", "left_semi").select("unit").distinct()
    state = marked.groupBy("parent").agg(F.count_if("has").alias("done"), F.count("*").alias("total"))
    return pending, stale, state.withColumn("status", F.when(F.col("done") == F.col("total"), "complete").otherwise("partial"))


def cached_searches(requests: DataFrame) -> DataFrame:
    """(seq, outcome): which searches a cache answers.

    ``requests`` is (seq, at, query, sources, most, refresh, complete, results). Equal searches, by ISBN or words, sources in any
    order and number, share an entry; a complete result is kept for ``KEEP_FOUND`` or, if empty, ``KEEP_EMPTY`` seconds from when it
    was found. Requests with one key are few and are folded in order.
    """
    isbn = I.canonical(F.col("query"))
    key = F.concat_ws("|", F.when(isbn != "", isbn).otherwise(F.trim("query")), F.array_join(F.array_sort(F.array_distinct("sources")), ","), F.col("most").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("seq", "at", "refresh", "complete", "results")))
    start = F.struct(F.lit(-1.0).alias("until"), F.array().cast("array<struct<seq:int,outcome:string>>").alias("told"))

    def step(s: Column, r: Column) -> Column:
        hit = ~r["refresh"] & (s["until"] > r["at"])
        until = F.when(hit, s["until"]).when(r["complete"], r["at"] + F.when(r["results"] > 0, KEEP_FOUND).otherwise(KEEP_EMPTY)).otherwise(-1.0)
        return F.struct(until.cast("double").alias("until"), F.concat(s["told"], F.array(F.struct(r["seq"].alias("seq"), F.when(hit, "cached").otherwise("run").alias("outcome")))).alias("told"))

    folded = requests.withColumn("key", key).groupBy("key").agg(listed.alias("r")).select(F.explode(F.aggregate("r", start, step)["told"]).alias("t"))
    return folded.select("t.seq", "t.outcome")


def mirror_order(mirrors: DataFrame, attempts: DataFrame, now: float) -> DataFrame:
    """(grp, mirror, turn, state): the order in which a group's mirrors are tried.

    ``mirrors`` is (grp, place, mirror), ``attempts`` (grp, mirror, at, code, status) with code ``ok`` for a success. The last
    that worked comes first; a mirror that failed as a whole waits for ``COOLDOWN`` seconds unless it has worked since.
    """
    past = attempts.where(F.col("at") <= now)
    preferred = past.where("code = 'ok'").groupBy("grp").agg(F.max_by("mirror", "at").alias("preferred"))
    broken = (F.col("code") != "ok") & (~F.col("code").isin("unexpected_page", "http_error") | F.coalesce(F.col("status") >= 500, F.lit(False)))
    last = past.where(broken | (F.col("code") == "ok")).groupBy("mirror").agg(F.max("at").alias("at"), F.max_by("code", "at").alias("code"))
    seen = mirrors.join(preferred, "grp", "left").join(last, "mirror", "left")
    waits = F.coalesce((F.col("code") != "ok") & (F.col("at") + COOLDOWN > now), F.lit(False))
    first = F.coalesce(F.col("mirror") == F.col("preferred"), F.lit(False))
    turn = F.row_number().over(Window.partitionBy("grp").orderBy(waits, F.desc(first), "place"))
    return seen.select("grp", "mirror", F.when(~waits, turn).alias("turn"), F.when(waits, F.concat(F.lit("cooldown:"), "code")).otherwise("eligible").alias("state"))


def passing(courses: DataFrame, fields: DataFrame, *, institutions: list[str] = (), exclude: list[str] = (), areas: list[str] = (), levels: list[str] = (), reviewed: bool = False) -> DataFrame:
    """Courses (course_id, institution, areas, levels, status) that a brief's filters let pass; ``fields`` (course_id, field, text) are
    searched for excluded phrases, word for word in normal form."""
    from .matching import normal_words

    kept = courses
    folded = lambda values: F.array(*[F.lit(v.casefold()) for v in values])
    if institutions:
        asked = F.array(*[institution(F.lit(i)) for i in institutions])
        kept = kept.where(F.array_contains(asked, institution(F.col("institution"))))
    if exclude:
        padded = F.concat(F.lit(" "), F.array_join(T.normal_forms(T.tokens(F.col("text"))), " "), F.lit(" "))
        hit = F.lit(False)
        for phrase in exclude:
            if words := normal_words(phrase):
                hit = hit | padded.contains(f" {' '.join(words)} ")
        kept = kept.join(fields.where(hit).select("course_id").distinct(), "course_id", "left_anti")
    for column, wanted in (("areas", areas), ("levels", levels)):
        if wanted:
            kept = kept.where(F.arrays_overlap(F.transform(F.coalesce(column, F.array().cast("array<string>")), F.lower), folded(wanted)))
    return kept.where(F.col("status") == "reviewed") if reviewed else kept


def discovery(readings: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Courses that a search may find, one an identity, and (course_key, title) of those without a named book, at most ``most``.

    ``readings`` is (course_key, institution, code, title, named_books, nondegree); courses for no degree are left out.
    """
    real = readings.where(~F.coalesce("nondegree", F.lit(False))).withColumn("identity", F.sha2(F.concat_ws("|", institution(F.col("institution")), F.lower(F.regexp_replace("code", r"\s+", "")), plain(F.col("title"))), 256))
    grouped = real.groupBy("identity").agg(F.min("title").alias("title"), F.array_sort(F.collect_set("course_key")).alias("source_keys"), F.sum("named_books").alias("named_books"))
    usable = grouped.where("named_books > 0").select("title", "source_keys", "named_books")
    backlog = grouped.where("named_books = 0").select(F.get("source_keys", F.lit(0)).alias("course_key"), "title").orderBy("title", "course_key").limit(most)
    return usable, backlog
