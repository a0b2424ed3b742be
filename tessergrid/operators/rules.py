"""Grounded classification: phrases of a taxonomy in fields of a course, which of them decides, and what a model may overrule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .identities import plain, words
from .phrase_search import phrase_places

# What a field group counts, areas of no or of every subject, words and phrases that do not go together.
TIERS = {"official_department": 4, "official_school": 2, "course_title_or_subject_code": 3, "course_description": 1}
UNRESOLVED, GENERAL = "other-academic-subject", "interdisciplinary-general"
NONHUMAN, GUARDED = r"\b(?:animal|plant|insect|veterinary)\b", ("physiology", "pathology", "anatomy", "nutrition")
TITLE_FIELDS = ("title", "course_title")
#: From here on a model's answer, a family's support and the mass of its anchors count.
SURE = 0.95
# Reasons that a resolved answer clears.
CLEARED = ("jev-subject-needs-review", "low-model-confidence", "insufficient-subject-evidence", "choice-distribution-conflict", "jev-invalid-answer", "jev-classification-not-completed", "jev-rule-field-disagreement")
# Reasons of rules that a model's answer takes the place of.
OF_FIELDS = ("unmapped-area", "conflicting-primary-areas", "description-only-area", "conflicting-source-classifications")
# Reasons against a fallback to rules.
UNSOUND = ("conflicting-primary-areas", "conflicting-source-classifications", "bookstore-identity-unverified")
# Fields that say what a course is about, and fields that say where it belongs.
SPECIFIC_FIELDS = ("title", "course_title", "description", "description_variants", "subject_description")
AFFILIATION_FIELDS = (
    "code", "course_code", "subject_code", "official_department_labels", "official_school_labels", "catalog_department", "academic_subject", "departments",
    "subject_areas", "school", "college", "institution_subject_context.department", "institutional_subject_context.department",
)


def phrase_evidence(fields: DataFrame, terms: DataFrame) -> DataFrame:
    """(course_key, area, basis, tier, field, phrase, n_words): phrases of a taxonomy that stand in fields, word for word.

    ``fields`` is (course_key, basis, field, text), ``terms`` (area, phrase, topic): topics are sought in titles and
    descriptions, others in departments and schools. Every text is read once, whatever the phrases' lengths.
    """
    tier = F.lit(0)
    for basis, t in TIERS.items():
        tier = F.when(F.col("basis") == basis, t).otherwise(tier)
    said = fields.select(F.struct("course_key", "basis", "field").alias("at"), words(F.col("text")).alias("w"))
    spelled = terms.select("area", plain(F.col("phrase")).alias("phrase"), "topic").distinct()
    found = phrase_places(said, "at", F.col("w"), spelled).select("at.*", "phrase").distinct()
    topical = F.col("basis").isin("course_title_or_subject_code", "course_description")
    beasts = fields.where(plain(F.col("text")).rlike(NONHUMAN)).select("course_key", "basis").distinct().withColumn("beasts", F.lit(True))
    # what may be shuffled once more are phrases found, before each stands once for every area
    marked = found.join(beasts, ["course_key", "basis"], "left").withColumns({"topic": topical, "tier": tier, "n_words": F.size(F.split("phrase", " "))})
    held = marked.join(spelled, ["phrase", "topic"]).where(~(F.coalesce("beasts", F.lit(False)) & F.col("topic") & (F.col("area") == "health-medicine") & F.col("phrase").isin(*GUARDED)))
    # a phrase found in a field and an area with that phrase are distinct, so their pairs are, and are not gathered once more
    return held.select("course_key", "area", "basis", "tier", "field", "phrase", "n_words")


def context_prefix(code: Column, subject_code: Column) -> Column:
    """The part of a code that names a subject: its subject code, else the letters, or digits with letters, that it starts with."""
    lead = F.regexp_extract(F.coalesce(code, F.lit("")), r"^(\d+[A-Za-z]*|[A-Za-z]+)(?=[.\s\d-]|$)", 1)
    return plain(F.when(F.coalesce(subject_code, F.lit("")) != "", subject_code).otherwise(lead))


def area_strengths(evidence: DataFrame) -> DataFrame:
    """(course_key, area, tier, words, topic, basis): the strongest evidence of each area, and how long its phrases in titles are."""
    topic = F.max(F.when(F.col("field").isin(*TITLE_FIELDS), F.col("n_words"))).alias("topic")
    best = F.max(F.struct("tier", "n_words", (F.col("basis") != "institution-subject-context").cast("int").alias("first"), "basis")).alias("b")
    return evidence.groupBy("course_key", "area").agg(best, topic).select("course_key", "area", "b.tier", F.col("b.n_words").alias("words"), F.coalesce("topic", F.lit(0)).alias("topic"), "b.basis")


def primary_areas(courses: DataFrame, strengths: DataFrame) -> DataFrame:
    """(course_key, primary, candidates, basis, reasons): the area that decides, where one does.

    ``courses`` is (course_key, parse_review, bookstore_only). Of areas in the strongest tier, a department leaves it to the
    longest topic in the title; elsewhere the longest phrase counts. What ties is unresolved.
    """
    own = Window.partitionBy("course_key")
    strengths = strengths.join(courses.where(~F.col("bookstore_only")).select("course_key"), "course_key")
    general = F.col("area") == GENERAL
    real = strengths.withColumn("only", F.min(general.cast("int")).over(own)).where(~general | (F.col("only") == 1))
    top = real.withColumn("most", F.max("tier").over(own)).where("tier = most")
    seen = top.withColumns({"n": F.count("*").over(own), "topic_best": F.max("topic").over(own), "longest": F.max("words").over(own)})
    by_topic = (F.col("most") >= 4) & (F.col("n") > 1) & (F.col("topic_best") > 0)
    chosen = seen.withColumn("by_topic", by_topic).where(F.when(F.col("by_topic"), F.col("topic") == F.col("topic_best")).otherwise(F.col("words") == F.col("longest")))
    basis = F.when(F.first("by_topic"), "specific-course-topic-within-department").otherwise(F.min_by("basis", "area"))
    told = chosen.groupBy("course_key").agg(F.array_sort(F.collect_list("area")).alias("found"), basis.alias("basis"), F.first("most").alias("most"))
    both = courses.join(told, "course_key", "left")
    none = F.col("found").isNull()
    several = F.coalesce(F.size("found") > 1, F.lit(False))
    reasons = [F.when(none, F.when(F.col("bookstore_only"), "bookstore-identity-unverified").otherwise("unmapped-area")), F.when(F.col("parse_review"), "source-parse-needs-review"), F.when(several, "conflicting-primary-areas"), F.when(F.col("most") == 1, "description-only-area")]
    return both.select(
        "course_key",
        F.when(none | several, UNRESOLVED).otherwise(F.get("found", F.lit(0))).alias("primary"),
        F.coalesce("found", F.array(F.lit(UNRESOLVED))).alias("candidates"),
        F.coalesce("basis", F.lit("unresolved-source-evidence")).alias("basis"),
        F.array_compact(F.array(*reasons)).alias("reasons"),
    )


def overlaid(rules: DataFrame, answers: DataFrame, refinements: DataFrame) -> DataFrame:
    """(course_key, primary, method, reasons, status, resolution): rules under a model's answer under its second look.

    ``rules`` is (course_key, rule_primary, resolved, candidates, tier, reasons, warned), ``answers`` (course_key, answer,
    status, why) with status candidate, needs-review or invalid, ``refinements`` alike. Where no answer holds, rules from a
    title or a department that nothing contradicts step in.
    """
    none = F.array().cast("array<string>")
    told = lambda df, p: df.select("course_key", F.col("answer").alias(f"{p}_answer"), F.col("status").alias(f"{p}_status"), F.coalesce("why", none).alias(f"{p}_why"))
    both = rules.join(told(answers, "a"), "course_key", "left").join(told(refinements, "r"), "course_key", "left")
    first, second = F.col("a_status"), F.col("r_status")
    differs = lambda answer: F.coalesce(~F.col("rule_primary").isin("", UNRESOLVED) & (F.col("rule_primary") != F.col(answer)), F.lit(False))
    once = (
        F.when(first.isNull(), F.array(F.lit("jev-classification-not-completed")))
        .when(first == "invalid", F.array(F.lit("jev-invalid-answer")))
        .when(first != "candidate", F.array_union(F.array(F.lit("jev-subject-needs-review")), F.col("a_why")))
        .when(differs("a_answer"), F.array(F.lit("jev-rule-field-disagreement")))
        .otherwise(none)
    )
    again = F.when(second != "candidate", F.array_union(F.array(F.lit("jev-subject-needs-review")), F.col("r_why"))).when(differs("r_answer"), F.array(F.lit("jev-rule-field-disagreement"))).otherwise(none)
    kept = F.array_union(F.array_except(F.coalesce("reasons", none), F.array(*[F.lit(x) for x in OF_FIELDS])), once)
    kept = F.when(second.isNull(), kept).otherwise(F.array_union(F.array_except(kept, F.array(*[F.lit(x) for x in CLEARED])), again))
    given = F.when(second.isNotNull(), F.col("r_answer")).when(first.isin("candidate", "needs-review"), F.col("a_answer")).otherwise(UNRESOLVED)
    strong = F.col("resolved") & (F.col("candidates") == F.array("rule_primary")) & ~F.col("rule_primary").isin("", UNRESOLVED) & (F.col("tier") >= 3) & ~F.arrays_overlap(F.coalesce("reasons", none), F.array(*[F.lit(x) for x in UNSOUND]))
    fall = (given == UNRESOLVED) & F.coalesce(strong, F.lit(False))
    primary = F.when(fall, F.col("rule_primary")).otherwise(given)
    kept = F.array_sort(F.when(F.col("warned"), F.array_union(kept, F.array(F.lit("bookstore-identity-unverified")))).otherwise(kept))
    made = both.select("course_key", primary.alias("primary"), F.when(fall, "source-grounded-rules-fallback-after-jev-review").otherwise("jev-source-metadata-candidate").alias("method"), kept.alias("reasons"))
    status = F.when((F.size("reasons") > 0) | (F.col("primary") == UNRESOLVED), "needs-review").otherwise("candidate")
    resolution = F.when(F.col("primary") == UNRESOLVED, "unresolved").when(F.col("method") == "jev-source-metadata-candidate", "model-candidate").otherwise("source-grounded-model-review")
    return made.withColumns({"status": status, "resolution": resolution})


def facet_union(layers: list[tuple[DataFrame, str]]) -> DataFrame:
    """(course_key, area, basis, fields): facets of several sources; the first layer that has an area names its basis, fields unite.

    A layer is (course_key, area, fields). Where some facet rests on what a course is about, those that rest on affiliation alone go.
    """
    every = None
    for i, (rows, name) in enumerate(layers):
        part = rows.select("course_key", "area", F.lit(name).alias("basis"), F.lit(i).alias("layer"), "fields")
        every = part if every is None else every.unionByName(part)
    one = every.groupBy("course_key", "area").agg(F.min_by("basis", "layer").alias("basis"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields"))
    about = F.arrays_overlap("fields", F.array(*[F.lit(x) for x in SPECIFIC_FIELDS]))
    alone = (F.size("fields") > 0) & (F.size(F.array_except("fields", F.array(*[F.lit(x) for x in AFFILIATION_FIELDS]))) == 0)
    return one.withColumn("any_about", F.max(about).over(Window.partitionBy("course_key"))).where(~F.col("any_about") | about | ~alone).drop("any_about")


def facet_decisions(support: DataFrame, anchors: DataFrame) -> DataFrame:
    """(facet, status, basis, mass, reasons): whether a facet is supported, and by which kinds of evidence.

    ``support`` is (facet, course, reading, choice, none_p, unknown_p, lexical), ``anchors`` (facet, anchor, kind, p). The mass is
    that of the anchors of supported kinds; a phrase found in the source outweighs it.
    """
    kinds = F.array_compact(F.array(F.when(F.col("course") >= SURE, "course"), F.when(F.col("reading") >= SURE, "reading")))
    held = support.withColumn("kinds", kinds)
    by = anchors.join(held.select("facet", "kinds", "choice"), "facet")
    mass = by.groupBy("facet").agg(F.sum(F.when(F.array_contains("kinds", F.col("kind")), F.col("p")).otherwise(0.0)).alias("mass"), F.max(F.when(F.col("anchor") == F.col("choice"), F.col("kind"))).alias("chosen_kind"))
    both = held.join(mass, "facet", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    bad = F.col("course").isNull() | F.col("reading").isNull()
    reasons = [
        F.when(F.size("kinds") == 0, "insufficient-subject-evidence"),
        F.when(~F.col("choice").isin("none", "unknown") & ~F.coalesce(F.array_contains("kinds", F.col("chosen_kind")), F.lit(False)) & ~F.col("lexical"), "support-anchor-basis-conflict"),
        F.when(((F.round("mass", 9) < SURE) | (F.round(F.col("none_p") + F.col("unknown_p"), 9) > 0.05)) & ~F.col("lexical"), "insufficient-anchor-support"),
    ]
    told = both.withColumn("reasons", F.array_compact(F.array(*reasons)))
    status = F.when(F.size("reasons") == 0, "candidate").when(bad, "invalid-answer").otherwise("needs-review")
    named = F.array_join("kinds", "-and-")
    basis = F.when(status == "candidate", F.when(named == "reading", "reading-context-candidate").when(named == "course", "course-metadata-candidate").otherwise("course-and-reading-context-candidate"))
    return told.select("facet", status.alias("status"), basis.alias("basis"), F.round("mass", 6).alias("mass"), "reasons")
