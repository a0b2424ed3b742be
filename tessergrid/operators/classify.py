"""Rule-based classification: phrases of a taxonomy against fields, tiers, tie-breaks, overlays."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def phrase_hits(df: DataFrame, key: str, fields: dict[str, int], taxonomy: dict[str, list[str]], guards: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """(key, area, tier, words): the strongest hit of each area, by tier of its field, then words of its phrase.

    The taxonomy is folded into the plan as literals; rows are never joined with it. ``guards`` maps an area to a
    pattern that suppresses the given phrases in a row.
    """
    parts = []
    for area, phrases in taxonomy.items():
        for field, tier in fields.items():
            for phrase in phrases:
                hit = F.lower(F.col(field)).rlike(rf"(?<!\w){re.escape(phrase)}(?!\w)")
                pattern, held = (guards or {}).get(area, ("", []))
                if phrase in held:
                    hit &= ~F.lower(F.col(field)).rlike(pattern)
                parts.append(F.when(hit, F.struct(F.lit(area).alias("area"), F.lit(tier).alias("tier"), F.lit(len(phrase.split())).alias("words"))))
    found = df.select(key, F.explode(F.array_compact(F.array(*parts))).alias("h"))
    best = found.groupBy(key, F.col("h.area").alias("area")).agg(F.max(F.struct("h.tier", "h.words")).alias("b"))
    return best.select(key, "area", "b.tier", "b.words")


def primary(hits: DataFrame, key: str, unresolved: str = "other") -> DataFrame:
    """(key, primary, candidates): the single strongest area, or ``unresolved`` where several tie."""
    w = Window.partitionBy(key).orderBy(F.desc("tier"), F.desc("words"))
    top = hits.withColumn("r", F.rank().over(w)).where("r = 1")
    return top.groupBy(key).agg(F.when(F.count("*") == 1, F.min("area")).otherwise(F.lit(unresolved)).alias("primary"), F.array_sort(F.collect_set("area")).alias("candidates"))


def gate(df: DataFrame, confidence: str, probabilities: str, least: float = 0.95) -> DataFrame:
    """Rows whose confidence and greatest probability both reach the threshold."""
    return df.where((F.col(confidence) >= least) & (F.array_max(F.map_values(F.col(probabilities))) >= least))


def distribution_faults(probabilities: Column, answer: Column) -> Column:
    """Names of the rules a probability map breaks: range, sum within min(.025, n * .005 + .0001) of 1, answer is the argmax."""
    values = F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    slack = F.least(F.lit(0.025), F.size(values) * 0.005 + 0.0001)
    best = F.element_at(probabilities, answer) == F.array_max(values)
    rules = (("range", F.forall(values, lambda x: (x >= 0) & (x <= 1))), ("sum", F.abs(total - 1) <= slack), ("argmax", best))
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def overlay(base: DataFrame, *layers: tuple[DataFrame, str], key: str, value: str) -> DataFrame:
    """(key, value, basis): the value of the first layer (rows, name) that has one, else the base's."""
    out = base.select(key, F.col(value).alias("_base"))
    names = []
    for i, (rows, name) in enumerate(layers):
        out = out.join(rows.select(key, F.col(value).alias(f"_{i}")), key, "left")
        names.append(F.when(F.col(f"_{i}").isNotNull(), F.lit(name)))
    values = [F.col(f"_{i}") for i in range(len(layers))]
    return out.select(key, F.coalesce(*values, "_base").alias(value), F.coalesce(*names, F.lit("base")).alias("basis"))


def fan_out(df: DataFrame, state: str, key: str, infer) -> DataFrame:
    """``infer`` applied to one row per distinct state, its answer given to every row with that state."""
    chosen = df.groupBy(state).agg(F.min(key).alias(key))
    answered = infer(df.join(chosen, [state, key], "left_semi"))
    return df.join(answered.drop(key), state)


def byte_batches(df: DataFrame, group: list[str], order: str, size: Column, most_bytes: int, most_rows: int) -> DataFrame:
    """batch: consecutive numbers such that a batch begins where bytes or rows would pass a multiple of their bounds."""
    w = Window.partitionBy(*group).orderBy(order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.row_number().over(w) - 1
    marks = df.withColumns({"_b": F.floor(before / most_bytes), "_n": F.floor(n / most_rows)})
    change = (F.col("_b") != F.lag("_b").over(w)) | (F.col("_n") != F.lag("_n").over(w))
    return marks.withColumn("_c", F.coalesce(change, F.lit(False)).cast("int")).withColumn("batch", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b", "_n", "_c")
