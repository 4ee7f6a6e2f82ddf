"""Severity of candidate sets: the maximal sets of mutually comparable claims of a key, each graded once.

Comparability is symmetric but not transitive, so a claim may be in several sets. It depends on conditions alone: sets
are found among the distinct conditions of a key, whose number doesn't grow with its claims, and claims are then
aggregated into them without ever being listed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from concordia.operators.conflicts import COMPONENT, compared_policy, condition_key, detect, gathered, graded
from concordia.plans import policy
from concordia.plans.schema import DIMENSIONS


def maximal_sets(comparable: list[int]) -> Iterator[list[int]]:
    """The maximal sets of mutually comparable items (Bron and Kerbosch with a pivot); comparable[i] is the bit mask of i's partners."""

    def items(mask: int) -> Iterator[int]:
        while mask:
            yield (mask & -mask).bit_length() - 1
            mask &= mask - 1

    stack = [(0, (1 << len(comparable)) - 1, 0)]
    while stack:
        chosen, may, done = stack.pop()
        if not may and not done:
            if chosen:
                yield list(items(chosen))
            continue
        pivot = max(items(may | done), key=lambda i: (comparable[i] & may).bit_count())
        for i in items(may & ~comparable[pivot]):
            stack.append((chosen | 1 << i, may & comparable[i], done & comparable[i]))
            may, done = may & ~(1 << i), done | 1 << i


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _sets_of(conditions: pd.Series) -> pd.Series:
    """The sets of each condition of a key, by their numbers; conditions are JSON texts of what they state."""
    known: dict[tuple, list] = {}

    def find(texts: tuple[str, ...]) -> list[list[int]]:
        if texts not in known:
            if len(known) >= 10_000:
                known.clear()
            stated = [{d: v for d, v in json.loads(t, parse_constant=str).items() if v is not None} for t in texts]
            fits = lambda a, b: all(b.get(d, v) == v for d, v in a.items())
            masks = [sum(1 << j for j, b in enumerate(stated) if j != i and fits(a, b)) for i, a in enumerate(stated)]
            sets = sorted(maximal_sets(masks))
            known[texts] = [[k for k, members in enumerate(sets) if i in members] for i in range(len(texts))]
        return known[texts]

    return pd.Series([find(tuple(x)) for x in conditions])


def memberships(claims: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, sets_of: of each key, a map from the text of an exact condition to the numbers (from 0) of its maximal sets."""
    texts = claims.select(*keys, F.to_json(condition_key(F.col("condition"))).alias("text")).distinct()
    per = texts.groupBy(*keys).agg(F.array_sort(F.collect_list("text")).alias("texts"))
    return per.select(*keys, F.map_from_arrays("texts", _sets_of("texts")).alias("sets_of"))


def graded_sets(claims: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name"), *, ascii_only: bool = False) -> DataFrame:
    """keys, set_no, condition (what its claims state together), n_claims, n_values, conflicts, conflict_class, severity of every set of two claims or more.

    A set conflicts when two of its claims do. Its class is that of its pairs where all of them are of one kind that
    depends on their values (units, editions), else it says whether records stand against the web, or one source or
    several against each other. Severity is that of pairs with the set in place of the pair: the range of all numbers,
    records only if all are, and the most values under one exact condition.
    """
    of = memberships(claims, keys)
    size = F.coalesce("scaled", "num")
    stated = F.struct(*[F.max(F.col("stated")[d]).alias(d) for d in DIMENSIONS])
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.min(c))  # noqa: E731  null where any is
    side = lambda f: f(F.struct("num", "scaled"), size)
    # All is joined by the keys alone, by which it already lies: nothing but the claims and their conditions is shuffled.
    members = gathered(claims, keys, ascii_only=ascii_only).join(of, list(keys)).withColumn("set_no", F.explode(F.col("sets_of")[F.col("condition_text")]))
    sets = members.groupBy(*keys, "set_no").agg(
        stated.alias("condition"), F.count(F.lit(1)).alias("n_claims"), F.count_distinct(F.coalesce(F.col("num").cast("string"), F.col("canon"))).alias("n_values"), side(F.min_by).alias("low"), side(F.max_by).alias("high"), whole("family").alias("family_l"), F.max("family").alias("family_r"),
        F.max("record").alias("some"), F.min("record").alias("every"), F.min("source_id").alias("source_l"), F.max("source_id").alias("source_r"), F.max("distinct_values").alias("values"),
    ).where("n_claims > 1")
    # Flags, not sets of names: they are combined map-side by a hash aggregate, however many pairs there are.
    of_kind = lambda *names: F.bool_or(F.col("conflict_class").isin(*names))
    kinds_of = {"units": of_kind("unit_normalization"), "editions": of_kind("temporal"), "others": of_kind("record_vs_web", "intra_document", "inter_document")}
    found = detect(claims, keys, ascii_only=ascii_only, carry=("condition_text",)).where("conflicts")
    pairs = found.groupBy(*keys, F.col("l.condition_text").alias("condition_text"), F.col("r.condition_text").alias("other_text")).agg(*[c.alias(n) for n, c in kinds_of.items()])
    common = F.array_intersect(F.col("sets_of")[F.col("condition_text")], F.col("sets_of")[F.col("other_text")])
    inside = pairs.join(of, list(keys)).withColumn("set_no", F.explode(common)).groupBy(*keys, "set_no").agg(F.struct(*[F.bool_or(n).alias(n) for n in kinds_of]).alias("kinds"))
    kinds = inside.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("set_no", "kinds"))).alias("kinds"))
    p = policy.with_policy(sets.join(kinds, list(keys), "left").withColumn("kinds", F.col("kinds")[F.col("set_no")]).withColumns({n: F.col("kinds")[n] for n in kinds_of}))
    special = F.when(F.col("units") & ~F.col("editions") & ~F.col("others"), "unit_normalization").when(F.col("editions") & ~F.col("units") & ~F.col("others"), "temporal")
    kind = F.when(F.col("some") != F.col("every"), "record_vs_web").when(F.col("source_l").eqNullSafe(F.col("source_r")), "intra_document").otherwise("inter_document")
    p = p.withColumn("conflicts", F.col("others").isNotNull()).withColumn("conflict_class", F.when(F.col("conflicts"), F.coalesce(special, kind)))
    l, r = ({"family": F.col(f"family_{x}"), "scaled_x": F.coalesce(f"{s}.scaled", F.lit(0.0)), "x": F.coalesce(f"{s}.num", F.lit(0.0)), "known": F.col(f"{s}.num").isNotNull(), "record": F.col("every"), "many": F.coalesce(F.col("values") >= 3, F.lit(False))} for x, s in (("l", "low"), ("r", "high")))  # noqa: E741
    p = compared_policy(p)
    return graded(p, l, r).select(*keys, "set_no", "condition", "n_claims", "n_values", "conflicts", "conflict_class", "severity")
