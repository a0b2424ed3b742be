"""Requirements against the fields of courses: task fit by passage, ranking, selection, coverage, acquisition.

Requirements are a handful of short texts: they are compiled on the driver and folded into the plan as literals.
Everything that grows, fields and passages, stays in DataFrames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import stored

# Verbs with which a requirement asks for work.
ACTIONS = (
    "understand", "know", "learn", "evaluate", "describe", "explain", "review", "apply", "advise", "design", "build", "choose", "select",
    "calibrate", "analyze", "analyse", "assess", "develop", "compare", "create", "implement", "plan", "support", "help", "interpret",
    "manage", "communicate", "investigate", "reconstruct",
)
# Words that say who wants something, not what.
ROLE_WORDS = ("engineer", "expertise", "need", "help", "work", "develop", "create", "build", "apply", "adviser", "advisor", "specialist", "guide", "user", "use", "support")
# Words of choosing, fields of teaching, fields of labels, titles, and codes.
CHOOSING = ("selection", "select", "selecting", "choose", "choosing")
TEACHING, LABELS, TITLES, CODES = ("description", "description_variants"), ("academic_areas", "expertise_tags"), ("title", "course_title"), ("code", "course_code", "subject_code")
#: The widest stretch of words within which subjects, and terms of a short field, may stand.
SUBJECT_SPAN, FIELD_SPAN, CHOICE_REACH = 8, 5, 3

_VERB = re.compile(rf"^(?:{'|'.join(ACTIONS)})\s+", re.I)


def normal_words(text: str) -> list[str]:
    return [T.WORD_FORMS.get(w, w) for w in re.findall(r"\w+", text.casefold())]


@dataclass(frozen=True)
class Wording:
    """One way to ask for a requirement, as the sets of words that a passage is held against."""

    requirement: str
    place: int
    query: str
    wanted: tuple[str, ...]
    subjects: tuple[str, ...]
    task: tuple[str, ...]
    action: str | None
    asks_work: bool
    choosing: bool
    in_context: bool


def compile_wordings(requirements: list[str], search_terms: dict[str, list[str]], context: str) -> list[Wording]:
    """The requirement itself and its other wordings, in order; those of generic words only are left out."""
    said = lambda x: set(normal_words(x)) - set(T.PLAN_STOP_WORDS)
    generic, roles = set(T.GENERIC_WORDS), set(ROLE_WORDS)
    around = said(context) - generic
    out = []
    for requirement in requirements:
        for place, query in enumerate([requirement, *search_terms.get(requirement, [])]):
            wanted = said(query) - roles
            if not wanted - generic:
                continue
            words = normal_words(query)
            out.append(
                Wording(
                    requirement, place, query, tuple(sorted(wanted)), tuple(sorted(said(_VERB.sub("", query.strip())) - generic)), tuple(sorted(said(requirement) - roles)),
                    words[0] if words and _VERB.match(query) else None, bool(_VERB.match(requirement)), "selection" in said(query),
                    "calibration" in wanted and not wanted - generic - {"calibration"} and bool(around),
                )
            )
    return out


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _literal(w: Wording) -> Column:
    phrase = f" {' '.join(normal_words(w.query))} "
    fields = {"requirement": w.requirement, "place": w.place, "query": w.query, "action": w.action, "asks_work": w.asks_work, "choosing": w.choosing, "in_context": w.in_context, "phrase": phrase}
    arrays = {"wanted": w.wanted, "subjects": w.subjects, "task": w.task, "anchors": tuple(x for x in w.wanted if x not in CHOOSING)}
    return F.struct(*[F.lit(v).cast(_TYPES[k]).alias(k) for k, v in fields.items()], *[_words(v).alias(k) for k, v in arrays.items()])


_TYPES = {"requirement": "string", "place": "int", "query": "string", "action": "string", "asks_work": "boolean", "choosing": "boolean", "in_context": "boolean", "phrase": "string"}


def narrowest(words: Column, terms: Column) -> Column:
    """The least distance between the ends of a stretch of ``words`` that has all ``terms``; over a million if there is none.

    Every occurrence closes the stretch that starts where the term that was last seen longest ago stands.
    """
    at = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(terms, x["w"]))
    last = lambda t, end: F.coalesce(F.array_max(F.transform(F.filter(at, lambda o: (o["i"] <= end["i"]) & (o["w"] == t)), lambda o: o["i"])), F.lit(-10_000_000))
    return F.coalesce(F.array_min(F.transform(at, lambda end: end["i"] - F.array_min(F.transform(terms, lambda t: last(t, end))))), F.lit(10_000_000))


def passages(fields: DataFrame) -> DataFrame:
    """(course_id, field, passage, words, said): teaching fields by sentence and line, others whole."""
    cut = F.when(F.col("field").isin(*TEACHING), F.split("text", r"(?<=[.!?;])\s+|\n+")).otherwise(F.array("text"))
    each = fields.select("course_id", "field", F.explode(cut).alias("passage")).withColumn("words", T.normal_forms(T.tokens(F.col("passage"))))
    return each.withColumn("said", F.array_except(F.array_distinct("words"), _words(T.PLAN_STOP_WORDS)))


def match_requirements(fields: DataFrame, requirements: list[str], *, search_terms: dict[str, list[str]] | None = None, context: str = "", single: bool = False) -> DataFrame:
    """Of (course_id, field, text): the best passage of each course for each requirement it may serve.

    course_id, requirement, query_used, field, passage, matched_terms, missing_terms, coverage, lexical_fit, strength,
    label_terms, context_review, work_review, support. ``single`` accepts one shared term.
    """
    wordings = compile_wordings(requirements, search_terms or {}, context)
    around = sorted(set(normal_words(context)) - set(T.PLAN_STOP_WORDS) - set(T.GENERIC_WORDS))
    spark = fields.sparkSession
    if not wordings:
        return spark.createDataFrame([], "course_id string, requirement string, query_used string, field string, passage string, matched_terms array<string>, missing_terms array<string>, coverage double, lexical_fit double, strength int, label_terms array<string>, context_review boolean, work_review boolean, support string")
    asked = F.array(*[_literal(w) for w in wordings])
    missing = sorted(set(around) - {"expert", "expertise", "agent", "adviser", "advisor", "specialist"})
    # matches, labels and context are read off the same passages: those with a word that any of them asks for are cut once
    of_use = sorted({w for a in wordings for w in a.wanted} | set(missing))
    cut = stored(passages(fields).where(F.arrays_overlap("said", _words(of_use))))
    met = cut.withColumn("a", F.explode(F.filter(asked, lambda a: F.arrays_overlap(F.col("said"), a["wanted"])))).withColumn("found", F.array_intersect("a.wanted", "said"))
    label = F.col("field").isin(*LABELS)
    labels = met.where(label).groupBy("course_id", F.col("a.requirement").alias("requirement"), F.col("a.place").alias("place")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("label_terms"))
    n_found, n_wanted, generic = F.size("found"), F.size("a.wanted"), _words(T.GENERIC_WORDS)
    subjects = F.array_intersect("a.subjects", "said")
    part = F.when(F.size("a.subjects") > 0, F.size(subjects) / F.size("a.subjects")).otherwise(0.0)
    where = lambda test: F.filter(F.transform("words", lambda w, i: F.when(test(w), i)), lambda x: x.isNotNull())
    near = F.exists(where(lambda w: w.isin(*CHOOSING)), lambda x: F.exists(where(lambda w: F.array_contains("a.anchors", w)), lambda y: F.abs(x - y) <= CHOICE_REACH))
    rules = [
        F.lit(single) | (n_wanted == 1) | (n_found >= 2),
        F.lit(not single) | (n_wanted == 1) | (F.array_join("found", " ") != "physical"),
        ~F.col("a.choosing") | near,
        ~F.col("a.in_context") | F.arrays_overlap("said", _words(around)),
        F.size(F.array_except("found", generic)) > 0,
        F.lit(single) | (F.size("a.subjects") == 0) | (part > 0.5) | ((part == 0.5) & F.coalesce(F.array_contains("found", F.col("a.action")), F.lit(False))),
        (F.size(subjects) < 2) | (part == 1) | (narrowest(F.col("words"), subjects) <= SUBJECT_SPAN),
        F.col("field").isin(*TEACHING) | (n_found < 2) | (narrowest(F.col("words"), F.col("found")) <= FIELD_SPAN),
    ]
    kept = met.where(~label)
    for rule in rules:
        kept = kept.where(rule)
    task = F.array_sort(F.array_intersect("a.task", "said"))
    phrase = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).contains(F.col("a.phrase"))
    strength = n_found + F.when(F.col("field").isin(*TITLES), 8).otherwise(0) + F.when(phrase, 5).otherwise(0)
    fit = F.when(F.size("a.task") > 0, F.size(task) / F.size("a.task")).otherwise(0.0)
    scored = kept.select("course_id", "field", "passage", "a", task.alias("task_found"), fit.alias("coverage"), (n_found / n_wanted).alias("lexical_fit"), strength.alias("strength"))
    rank = F.struct(F.col("field").isin(*TEACHING).alias("t"), "coverage", "lexical_fit", "strength", "field", "passage", "task_found", F.col("a.query").alias("query_used"), F.col("a.task").alias("task"), F.col("a.asks_work").alias("asks_work"))
    per_wording = scored.groupBy("course_id", F.col("a.requirement").alias("requirement"), F.col("a.place").alias("place")).agg(F.max(rank).alias("b"))
    labelled = per_wording.join(labels, ["course_id", "requirement", "place"], "left")
    # of several wordings the best, of equal ones the first
    best = labelled.groupBy("course_id", "requirement").agg(F.max(F.struct("b.coverage", "b.lexical_fit", "b.strength", (-F.col("place")).alias("p"), "b", F.coalesce("label_terms", F.array().cast("array<string>")).alias("labels"))).alias("m"))
    source = cut.where(~F.col("field").isin(*LABELS, *CODES)).select("course_id", F.explode("said").alias("w")).where(F.col("w").isin(missing)).groupBy("course_id").agg(F.count_distinct("w").alias("n_context"))
    b = F.col("m.b")
    out = best.join(source, "course_id", "left").withColumn("context_review", F.lit(bool(missing)) & (F.coalesce("n_context", F.lit(0)) < len(missing)))
    support = F.when(b["coverage"] == 0, "supporting").when(F.col("context_review"), "context-review-needed").when(b["coverage"] == 1, "direct").otherwise("partial")
    return out.select(
        "course_id", "requirement", b["query_used"].alias("query_used"), b["field"].alias("field"), b["passage"].alias("passage"), b["task_found"].alias("matched_terms"),
        F.array_sort(F.array_except(b["task"], b["task_found"])).alias("missing_terms"), b["coverage"].alias("coverage"), b["lexical_fit"].alias("lexical_fit"), b["strength"].alias("strength"),
        F.col("m.labels").alias("label_terms"), "context_review", b["asks_work"].alias("work_review"), support.alias("support"),
    )


def reviewed_matches(matches: DataFrame, reviews: DataFrame, *, required: bool = False) -> DataFrame:
    """Matches with the last review (course_id, requirement, decision, field, quote, at) of each pair put over them.

    A rejected pair goes; a reviewed one counts as fully covered, by its quote; with ``required`` only reviewed pairs stay.
    """
    last = reviews.groupBy("course_id", "requirement").agg(F.max_by(F.struct("decision", "field", "quote"), "at").alias("r"))
    both = matches.join(last, ["course_id", "requirement"], "full_outer").where(F.coalesce(F.col("r.decision") != "reject", F.lit(True)))
    if required:
        both = both.where("r is not null")
    seen = F.col("r").isNotNull()
    none = F.array().cast("array<string>")
    over = {
        "field": F.col("r.field"), "passage": F.col("r.quote"), "coverage": F.lit(1.0), "lexical_fit": F.lit(None).cast("double"), "strength": F.lit(10), "matched_terms": none, "missing_terms": none,
        "label_terms": none, "context_review": F.lit(False), "work_review": F.lit(False), "query_used": F.lit(None).cast("string"), "support": F.when(F.col("r.decision") == "supplemental", "supporting").otherwise("direct"),
    }
    return both.withColumns({k: F.when(seen, v).otherwise(F.col(k)) for k, v in over.items()}).withColumns({"reviewed": seen, "decision": F.col("r.decision")}).drop("r")


def rank_matches(matches: DataFrame, courses: DataFrame, similarities: DataFrame, deliverables: list[str]) -> DataFrame:
    """``position`` (from 1) and ``fit`` (equal fits share one) within each requirement, by the ten keys of a selection.

    ``courses`` is (course_id, classified, named_material); courses without a named book are unusable.
    """
    usable = matches.join(courses.where("named_material"), "course_id").join(similarities, ["course_id", "requirement"], "left")
    delivers = F.sum(F.when(F.col("requirement").isin(deliverables), F.col("coverage")).otherwise(0.0)).over(Window.partitionBy("course_id"))
    ready = usable.withColumn("deliverable_fit", delivers).withColumn("similarity", F.coalesce("similarity", F.lit(-1.0)))
    keys = [
        (~F.col("reviewed")).asc(), F.coalesce(F.col("decision") == "supplemental", F.lit(False)).asc(), F.desc("coverage"), F.desc("deliverable_fit"), F.desc("strength"), F.col("context_review").asc(),
        (F.col("classified") != "reviewed").asc(), F.desc("similarity"), (~F.col("named_material")).asc(),
    ]
    own = Window.partitionBy("requirement")
    return ready.withColumn("fit", F.dense_rank().over(own.orderBy(*keys))).withColumn("position", F.row_number().over(own.orderBy(*keys, "course_id")))


def rerank_by_strength(ranked: DataFrame, evidence: DataFrame, provider_order: list[str]) -> DataFrame:
    """``position`` within equal fits by rank bands (low, high), where all courses of the fit share an evidence group and
    no two different bands of it overlap. ``evidence`` is (requirement, course_id, provider, year, subject, version, low, high)."""
    group = ["requirement", "fit"]
    sized = ranked.withColumn("members", F.count("*").over(Window.partitionBy(*group)))
    held = sized.select(*group, "course_id", "members").join(evidence, ["requirement", "course_id"])
    one = [*group, "provider", "year", "subject", "version"]
    common = held.groupBy(*one).agg(F.count_distinct("course_id").alias("n"), F.first("members").alias("members")).where("n = members and members > 1")
    preferred = F.coalesce(F.array_position(_words(provider_order), F.col("provider")), F.lit(0))
    order = F.struct(F.when(preferred > 0, preferred).otherwise(F.lit(1 << 30)).alias("o"), (-F.col("year")).alias("y"), "provider", "year", "subject", "version")
    chosen = common.groupBy(*group).agg(F.min(order).alias("g")).select(*group, "g.provider", "g.year", "g.subject", "g.version")
    bands = held.join(chosen, one).select(*group, "course_id", "low", "high")
    before = F.max("high").over(Window.partitionBy(*group).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    mixed = bands.select(*group, "low", "high").distinct().withColumn("before", before).where("before >= low").select(*group).distinct()
    sound = bands.join(mixed, group, "left_anti")
    placed = sized.join(sound, [*group, "course_id"], "left").withColumn("first", F.min("position").over(Window.partitionBy(*group)))
    again = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("low").asc_nulls_last(), F.col("high").asc_nulls_last(), "position")) - 1
    return placed.withColumn("position", F.when(F.col("low").isNotNull(), F.col("first") + again).otherwise(F.col("position")).cast("int")).drop("members", "first")


def select_courses(ranked: DataFrame, per_requirement: int, priorities: DataFrame) -> DataFrame:
    """(requirement, course_id, position, tier, selection_kind, role): the first of each requirement; ``role`` is a course's strongest tier.

    Only the first of an essential requirement is a must: if it matches directly and asks for no work, or a review calls it essential.
    """
    top = ranked.where(F.col("position") <= per_requirement).join(F.broadcast(priorities), "requirement", "left").withColumn("priority", F.coalesce("priority", F.lit("essential")))
    direct = (F.col("coverage") == 1) & ~F.col("context_review") & ~F.col("work_review")
    sure = F.when(F.col("reviewed"), F.col("decision") == "essential").otherwise(direct)
    must = (F.col("position") == 1) & (F.col("priority") == "essential") & sure
    tier = F.when(must, "must-have").otherwise("supplemental")
    kind = F.when(must, "primary").when(F.col("priority") == "essential", "alternative").otherwise("supplemental-interest")
    tiered = top.withColumns({"tier": tier, "selection_kind": kind})
    return tiered.withColumn("role", F.min("tier").over(Window.partitionBy("course_id"))).select("requirement", "course_id", "position", "tier", "selection_kind", "role")


def coverage_of(requirements: DataFrame, matches: DataFrame) -> DataFrame:
    """(requirement, status, n_links, gap_kind): what the chosen courses' matches say of each requirement."""
    sure = (F.col("coverage") == 1) & ~F.col("context_review") & ~F.col("work_review") & (F.col("support") != "supporting") & F.coalesce(F.col("decision") != "supplemental", F.lit(True))
    links = matches.groupBy("requirement").agg(F.count("*").alias("n_links"), F.bool_or(sure).alias("sure"), F.bool_and("context_review").alias("pending"))
    told = requirements.join(links, "requirement", "left")
    status = F.when(F.col("sure"), "candidate-match").when(F.col("n_links") > 0, "partial-candidate-match").otherwise("uncovered")
    gap = F.when(F.col("sure"), F.lit(None).cast("string")).when(F.col("pending"), "task-context-review").when(F.col("n_links") > 0, "partial-task-fit").otherwise("missing-task-evidence")
    return told.select("requirement", status.alias("status"), F.coalesce("n_links", F.lit(0)).alias("n_links"), gap.alias("gap_kind"))


def acquisitions(materials: DataFrame) -> DataFrame:
    """(key, priority, exact, assignments): what to obtain, once for each verified edition, else once for each listing.

    ``materials`` is (course_id, course_role, source_key, line, key, title, authors, edition, verified, reading_role).
    """
    role = F.lower(F.coalesce("reading_role", F.lit("not_stated")))
    spare = role.rlike("optional|recommended|suggested|supplemental|supplementary")
    asked = role.rlike("required|assigned|primary") & ~role.contains("not")
    priority = F.when(spare, "supplemental").when(asked, F.col("course_role")).otherwise("review-needed")
    exact = F.coalesce("verified", F.lit(False)) & (F.col("edition") != "") & (F.col("authors") != "")
    apart = F.when(~exact, F.concat_ws("|", "course_id", "source_key", F.col("line").cast("string"))).otherwise("")
    rank = F.when(priority == "must-have", 2).when(priority == "review-needed", 1).otherwise(0)
    named = materials.withColumns({"exact": exact, "apart": apart, "rank": rank, "identity": F.concat_ws("|", F.col("key"), F.lower("title"), F.lower("authors"), F.lower("edition"))})
    grouped = named.groupBy("identity", "apart").agg(F.first("key").alias("key"), F.first("exact").alias("exact"), F.max("rank").alias("rank"), F.array_sort(F.collect_list("course_id")).alias("assignments"))
    return grouped.select("key", "exact", F.when(F.col("rank") == 2, "must-have").when(F.col("rank") == 1, "review-needed").otherwise("supplemental").alias("priority"), "assignments")
