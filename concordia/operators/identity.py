"""Entity resolution of products: model decomposition, scores of candidate pairs, keys and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.functions.values import places
from concordia.plans.policy import SUFFIX_RULES

# Weights of the signals and the two thresholds.
WEIGHTS = {"manufacturer": 0.35, "family": 0.30, "bin": 0.15, "variant": 0.10, "electrical": 0.10}
MERGE, VARIANT = 0.90, 0.70
# Measurements that corroborate, and by how much they may differ.
MEASURES = (("pmax", 1.0), ("voc", 0.0), ("isc", 0.0))


def model_tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("[0-9]+|[a-z+*]+"), F.lit(0))


def decompose(tokens: Column, *nameplates: Column) -> Column:
    """struct(family, bin_watts, variants) of model tokens: the first number within 1 of the first known nameplate is
    masked; the family ends with it, the tokens after it are variants. Without one all tokens are the family."""
    target = F.coalesce(*nameplates) if len(nameplates) > 1 else nameplates[0]
    at = F.array_position(F.transform(tokens, lambda t: F.coalesce(F.abs(t.try_cast("double") - target) <= 1, F.lit(False))), F.lit(True)).cast("int")
    masked = F.concat(F.slice(tokens, F.lit(1), at - 1), F.array(F.lit("#")))
    found = at > 0
    return F.struct(
        F.array_join(F.when(found, masked).otherwise(tokens), " ").alias("family"),
        F.when(found, F.try_element_at(tokens, at).try_cast("double")).alias("bin_watts"),
        F.when(found, F.slice(tokens, at + 1, F.size(tokens))).otherwise(F.array().cast("array<string>")).alias("variants"),
    )


def _keyed(candidates: DataFrame, ascii_only: bool) -> DataFrame:
    key = text.manufacturer_key_ascii if ascii_only else text.manufacturer_key
    fold = (lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z+*]+", " ")) if ascii_only else text.model_text
    return candidates.withColumns({"mfr_key": key(F.col("manufacturer")), "tokens": model_tokens(fold(F.col("model")))})


def prepared(candidates: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """Add, once a row, what pairs read: mfr_key, tokens, own (their decomposition by the own nameplate), and the decimal
    places of each measurement."""
    return _read(_keyed(candidates, ascii_only))


def _read(keyed: DataFrame) -> DataFrame:
    return keyed.withColumns({"own": decompose(F.col("tokens"), F.col("nameplate")), "decimals": F.struct(*[places(text.python_repr(F.col(m))).alias(m) for m, _ in MEASURES])})


def _agrees(l: Column, r: Column, measure: str, magnitude: float) -> Column:  # noqa: E741
    """Whether two measurements agree within magnitude or the precision with which both were written."""
    floor = F.lit(0.5) * F.pow(F.lit(10.0), -F.least(l["decimals"][measure], r["decimals"][measure]).cast("double"))
    return F.abs(l[measure] - r[measure]) <= F.greatest(F.lit(magnitude), floor)


def score(pairs: DataFrame) -> DataFrame:
    """Score pairs of prepared candidates (structs l, r): adds score, outcome, signals, notes.

    same_product needs MERGE, an electrical measurement that agrees and variants that agree; VARIANT and more is a variant
    mismatch, which is no conflict of specifications; anything else is distinct. A name without a key scores 0.
    """
    l, r = F.col("l"), F.col("r")  # noqa: E741
    # A side without a nameplate is read by the other's.
    d = pairs.withColumns({"__a": F.when(l["nameplate"].isNotNull(), l["own"]).otherwise(decompose(l["tokens"], r["nameplate"])), "__b": F.when(r["nameplate"].isNotNull(), r["own"]).otherwise(decompose(r["tokens"], l["nameplate"]))})
    a, b = F.col("__a"), F.col("__b")
    same = l["mfr_key"] == r["mfr_key"]
    extra = F.array_sort(F.array_union(F.array_except(a["variants"], b["variants"]), F.array_except(b["variants"], a["variants"])))
    rules = F.create_map(*[x for (m, t), v in SUFFIX_RULES.items() for x in (F.lit(f"{m}|{t}"), F.lit(v))])
    verdicts = F.transform(extra, lambda t: F.when(same, F.coalesce(F.try_element_at(rules, F.concat(l["mfr_key"], F.lit("|"), t)), F.lit("significant"))).otherwise("significant"))
    agree = (a["variants"] == b["variants"]) | F.forall(verdicts, lambda v: v == "safe")
    both_bins = a["bin_watts"].isNotNull() & b["bin_watts"].isNotNull()
    bins = F.when(both_bins, F.abs(a["bin_watts"] - b["bin_watts"]) <= 1).otherwise(F.coalesce(F.abs(l["nameplate"] - r["nameplate"]) <= 1, F.lit(False)))
    measured = [F.when(l[k].isNotNull() & r[k].isNotNull(), _agrees(l, r, k, m)) for k, m in MEASURES]
    electrical = F.coalesce(*measured).isNotNull()
    for m in measured:
        electrical = electrical & F.coalesce(m, F.lit(True))
    signals = {"manufacturer": same, "family": a["family"] == b["family"], "bin": bins, "variant": agree, "electrical": electrical}
    parts = {k: F.when(F.coalesce(v, F.lit(False)), F.lit(WEIGHTS[k])).otherwise(0.0) for k, v in signals.items()}
    total = F.lit(0.0)
    for v in parts.values():
        total = total + v
    named = l["mfr_key"].isNotNull() & r["mfr_key"].isNotNull()
    d = d.withColumns({"score": F.when(named, F.round(total, 10)).otherwise(0.0), "signals": F.struct(*[v.alias(k) for k, v in parts.items()]), "notes": F.zip_with(extra, verdicts, lambda t, v: F.concat(t, F.lit(": "), v))})
    outcome = F.when(~named, "distinct").when((F.col("score") >= MERGE) & (F.col("signals.electrical") > 0) & agree, "same_product").when(F.col("score") >= VARIANT, "variant_mismatch").otherwise("distinct")
    return d.withColumn("outcome", outcome).drop("__a", "__b")


def candidate_pairs(candidates: DataFrame, block: list[str], order: str) -> DataFrame:
    """Unordered pairs that share the blocking columns; a null block never meets another."""
    left, right = (candidates.select(*block, F.struct(*candidates.columns).alias(s)) for s in "lr")
    return left.join(right, block).where(F.col("l")[order] < F.col("r")[order]).select("l", "r")


def class_scores(components: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """l, r, n_pairs, score, outcome, signals, notes for pairs of equal manufacturer key: components that agree in all
    that a score reads are one class, scored once against every other class, and n_pairs counts the pairs it stands for.

    The block loses nothing: without the manufacturer's weight no pair reaches VARIANT. A name without a key meets none.
    """
    numbers = ["nameplate", *[m for m, _ in MEASURES]]
    rows = components.groupBy("manufacturer", "model", *numbers).agg(F.count(F.lit(1)).alias("n"))
    classes = _keyed(rows, ascii_only).where("mfr_key is not null").groupBy("mfr_key", "tokens", *numbers).agg(F.sum("n").alias("n"))
    classes = _read(classes).withColumn("__class", F.struct("tokens", *numbers))
    left, right = (classes.select("mfr_key", F.struct(*classes.columns).alias(s)) for s in "lr")
    l, r = F.col("l"), F.col("r")  # noqa: E741
    pairs = left.join(right, "mfr_key").where(l["__class"] <= r["__class"])
    n = F.when(l["__class"] == r["__class"], F.expr("l.n * (l.n - 1) div 2")).otherwise(l["n"] * r["n"])
    return score(pairs.select("l", "r", n.alias("n_pairs")).where("n_pairs > 0"))


def identity_keys(components: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """Add manufacturer_key, model_family and surrogate_id (16 hex digits of SHA-256) to (manufacturer, model, nameplate)."""
    p = _keyed(components, ascii_only)
    family = decompose(F.col("tokens"), F.col("nameplate"))["family"]
    unit = F.lit("\x1f")
    p = p.withColumns({"manufacturer_key": F.col("mfr_key"), "model_family": family})
    digest = F.sha2(F.concat(F.col("mfr_key"), unit, F.col("model_family"), unit, text.python_repr(F.col("nameplate"))), 256)
    return p.withColumn("surrogate_id", F.substring(digest, 1, 16)).drop("mfr_key", "tokens")


def in_order(components: DataFrame) -> DataFrame:
    """Components in their total order; empty keys fall back to the names, a missing nameplate comes first."""
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    return components.orderBy("component_category", pick("manufacturer_key", "manufacturer"), pick("model_family", "model"), F.coalesce("nameplate", F.lit(float("-inf"))), F.coalesce("surrogate_id", F.lit("")))


def placed(components: DataFrame, path: str) -> DataFrame:
    """Components with their place (from 1) in the total order, sorted in ranges and written to path; a range starts where those before it end."""
    in_order(components).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    done = components.sparkSession.read.parquet(path).withColumn("__range", F.shiftright("__at", 33))
    counts = done.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, not for each component
    starts = counts.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return done.join(F.broadcast(starts), "__range").withColumn("place", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*components.columns, "place")
