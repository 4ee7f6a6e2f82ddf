"""Confidence of extracted fields, review routing, flags, and the threshold that meets a precision target."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.plans.schema import WEB

# Weights of the signals, and what an unobserved signal counts.
WEIGHTS = {"schema_valid": 0.30, "cross_field_consistent": 0.25, "ocr_confidence": 0.20, "second_read_agrees": 0.15, "unit_normalised": 0.05, "had_text_layer": 0.05}
UNOBSERVED = 0.5


def fuse(signals: dict[str, Column]) -> Column:
    """Weighted sum of signals (booleans or 0..1), rounded to ten digits; an unobserved signal counts half."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * F.coalesce(signals[name].cast("double"), F.lit(UNOBSERVED))
    return F.round(total, 10)


def requires_review(tier: Column, confidence: Column, threshold: float) -> Column:
    """Tier A always, any other field below the threshold."""
    return (tier == "a") | (confidence < threshold)


def flags(value_present: Column, source_tier: Column, confidence: Column, status: Column, threshold: float) -> Column:
    """Flags of a cell, several at once, in the words of the vocabulary cell_flag."""
    return F.array_compact(F.array(F.when(~value_present, F.lit("missing_data")), F.when(source_tier == WEB, F.lit("web_supplemented")), F.when(confidence < threshold, F.lit("low_confidence")), F.when(status.isin("open", "insufficient_evidence"), F.lit("unresolved_conflict"))))


def unresolved_fields(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted names of the fields of each component whose conflict is open or lacks evidence."""
    return fields.where(F.col("conflict_status").isin("open", "insufficient_evidence")).groupBy(*keys).agg(F.array_sort(F.collect_set("field_name")).alias("unresolved"))


def risk_coverage(scored: DataFrame, by: list[str], slots: int = 256) -> DataFrame:
    """by, score, n, precision, coverage for every score that occurs: what accepting all fields of at least it would give.

    Fields of one score are accepted together. Running sums are taken without bringing a group to one task: scores are
    dealt into ranges by quantiles of all distinct scores, a range of a group starts with what the ranges above it hold,
    and only the scores of one range are sorted together. A field without a score is never accepted, but counts in the
    coverage; one whose correctness is null isn't correct.
    """
    one = scored.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("correct").cast("int")), F.lit(0)).alias("good"))
    edges = one.where("score is not null").agg(F.percentile_approx(F.col("score").cast("double"), [k / slots for k in range(1, slots)], 20 * slots).alias("e")).first()["e"] or []
    placed = one.withColumn("slot", F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: e > F.col("score").cast("double"))) if edges else F.lit(0))
    above, whole = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    parts = placed.groupBy(*by, "slot").agg(F.sum(F.when(F.col("score").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("score").isNotNull(), F.col("good")).otherwise(0)).alias("good"), F.sum("n").alias("every"))
    starts = parts.select(*[F.col(c).alias(f"__{c}") for c in (*by, "slot")], F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("good").over(above), F.lit(0)).alias("good0"), F.sum("every").over(whole).alias("every"))
    down = Window.partitionBy(*by, "slot").orderBy(F.desc("score"))
    running = placed.where("score is not null").select(*by, "slot", "score", F.sum("n").over(down).alias("n"), F.sum("good").over(down).alias("good"))
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "slot")])
    n = F.col("n") + F.col("n0")
    return running.join(starts, same).select(*by, "score", n.alias("n"), ((F.col("good") + F.col("good0")) / n).alias("precision"), (n / F.col("every")).alias("coverage"))


def thresholds(scored: DataFrame, by: list[str], target: float, slots: int = 256) -> DataFrame:
    """The least score of each group at which the precision meets the target, with its coverage; exact, scores are not rounded."""
    ok = risk_coverage(scored, by, slots).where(F.col("precision") >= target)
    return ok.groupBy(*by).agg(F.min("score").alias("threshold"), F.max("coverage").alias("coverage"))


def review_share(routed: DataFrame) -> DataFrame:
    """The share of fields that need a review, held against the budget by the caller."""
    return routed.agg(F.avg(F.col("requires_review").cast("double")).alias("review_share"))


def hard_gates(df: DataFrame, row_keys: list[str]) -> DataFrame:
    """Flag what no score may pass: value not verbatim in its source, parsers that disagree, an implausible value, a poor
    scan, or a gap whose table row has a value elsewhere."""
    sibling = F.max(F.col("value_text").isNotNull()).over(Window.partitionBy(*row_keys))
    absent = F.col("value_text").isNotNull() & ~F.coalesce(F.contains(F.col("source_text"), F.col("value_text")), F.lit(False))
    gate = absent | ~F.col("parsers_agree") | ~F.col("plausible") | F.col("poor_scan") | (F.col("value_text").isNull() & sibling)
    return df.withColumn("hard_gate", F.coalesce(gate, F.lit(True)))


def plausible_module(pmax: Column, vmp: Column, imp: Column, voc: Column, isc: Column, ptc: Column, gamma: Column) -> Column:
    """Names of the electrical rules that a module's values break; a rule with a missing value isn't judged."""
    rules = {"power": F.abs(pmax - vmp * imp) <= 0.005 * pmax, "voltage": voc > vmp, "current": isc > imp, "ptc_ratio": (100 * ptc / pmax).between(87, 96), "gamma": F.abs(gamma).between(0.15, 0.70) & (gamma < 0)}
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def plausible_warranty(end: Column, first_year: Column, annual: Column, years: Column) -> Column:
    """Whether the end of a linear warranty follows from its first year and annual loss."""
    return F.abs(end - (100 - first_year - annual * (years - 1))) <= 0.5
