"""Aliases and the identities of what isn't a module: closed alias groups, inverters, storage, and equal products of other origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.sources.folders import checkpoint_folder


def closed(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """name, canonical: the least name that is reachable over alias pairs, for every name in them.

    Each round takes the least label among a name's own and its partners', then that label's label, so labels travel
    twice as far each time; minima are aggregated before the shuffle. A round is a table in the shared folder, and the
    loop ends when no label changed. Null names, and pairs of one name, link nothing (a name paired with itself stays).
    """
    spark = pairs.sparkSession
    p = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null")
    edges = _written(spark, p.where("a <> b").unionByName(p.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _written(spark, p.select(F.col("a").alias("name")).unionByName(p.select(F.col("b").alias("name"))).distinct().withColumn("canonical", F.col("name")))
    while True:
        near = edges.join(labels, edges["b"] == labels["name"]).groupBy("a").agg(F.min("canonical").alias("near"))
        least = labels.join(near, labels["name"] == near["a"], "left").select("name", F.least("canonical", "near").alias("canonical"), F.col("canonical").alias("before"))
        least = _written(spark, least)
        further = least.select(F.col("name").alias("of"), F.col("canonical").alias("further"))
        now = _written(spark, least.join(further, least["canonical"] == further["of"], "left").select("name", F.least("canonical", "further").alias("canonical"), "before"))
        labels = now.select("name", "canonical")
        if now.where("canonical <> before").isEmpty():
            return labels


def _written(spark, df: DataFrame) -> DataFrame:
    path = checkpoint_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def resolved(names: Column, closure: DataFrame, df: DataFrame, out: str = "canonical") -> DataFrame:
    """df with the canonical name of names, itself where it has no alias."""
    known = closure.select(F.col("name").alias("__name"), F.col("canonical").alias("__canonical"))
    return df.withColumn("__of", names).join(known, F.col("__of") == F.col("__name"), "left").withColumn(out, F.coalesce("__canonical", "__of")).drop("__of", "__name", "__canonical")


# The token that says where a product was made and nothing of what it is; prefixes that only decorate.
ORIGIN = "dom"
PREFIXES = ("cps",)


def model_tokens(model: Column) -> Column:
    """Tokens of a model string: braces' contents left out, separators equal, case folded, a decorating prefix dropped.

    Letters and digits are tokens of their own, so that ``STP 50-US`` and ``STP50-US`` are alike.
    """
    bare = F.lower(F.regexp_replace(model, r"\{[^}]*\}", " "))
    tokens = F.regexp_extract_all(bare, F.lit(r"[0-9]+|[a-z+]+"), F.lit(0))
    return F.when(F.get(tokens, F.lit(0)).isin(*PREFIXES), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)


def braced(model: Column) -> Column:
    """What a model string says in braces, kept as attributes."""
    return F.transform(F.regexp_extract_all(model, F.lit(r"\{([^}]*)\}"), F.lit(1)), lambda x: F.trim(x))


def inverter_family(model: Column) -> Column:
    """The series letters of an inverter's model: numbers are power at one tap of the same box, the origin token is no difference."""
    return F.array_join(F.filter(model_tokens(model), lambda t: ~t.rlike("^[0-9]+$") & (t != ORIGIN)), " ")


def _digest(parts: list[Column]) -> Column:
    """16 hex digits over all parts; null where one is missing, as an incomplete key must not match anything."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    return F.when(whole, F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 16))


def inverter_keys(df: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """Add manufacturer_key, model_family, domestic and inverter_key to inverters.

    df has manufacturer, model, dc_voltage_class, ac_nominal_voltage, ac_nominal_current, mppt_count and certifications
    (an array; its order and repeats don't matter). The key covers all of them but the power number, which is the same
    box at another voltage or not at all; without one of them there is no key. domestic says whether the model names its
    origin: such parts have the key of those that don't, while their compliance fields stay apart.
    """
    named = text.manufacturer_key_ascii(F.col("manufacturer")) if ascii_only else text.manufacturer_key(F.col("manufacturer"))
    out = df.withColumns({"manufacturer_key": named, "model_family": F.nullif(inverter_family(F.col("model")), F.lit("")), "domestic": F.array_contains(model_tokens(F.col("model")), ORIGIN)})
    certified = F.array_join(F.array_sort(F.array_distinct(F.transform("certifications", lambda c: F.lower(F.trim(c))))), ",")
    parts = [F.col("manufacturer_key"), F.col("model_family"), F.col("dc_voltage_class").cast("long"), F.col("ac_nominal_voltage").cast("long"), F.col("ac_nominal_current").cast("long"), F.col("mppt_count").cast("long"), certified]
    return out.withColumn("inverter_key", _digest(parts))


def storage_keys(df: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """Add manufacturer_key, group and storage_key to storage systems (manufacturer, model, capacity_kwh).

    group is ``structured`` where the model has letters and a number, ``marketing`` where it has no number at all and
    so can't be told from others of its maker, ``unnamed`` without a model. Only structured models have a key, of their
    tokens and capacity: hours and other trailing counts of power units are part of the tokens.
    """
    named = text.manufacturer_key_ascii(F.col("manufacturer")) if ascii_only else text.manufacturer_key(F.col("manufacturer"))
    tokens = F.filter(model_tokens(F.col("model")), lambda t: t != ORIGIN)
    number, letters = F.exists(tokens, lambda t: t.rlike("^[0-9]+$")), F.exists(tokens, lambda t: ~t.rlike("^[0-9]+$"))
    kind = F.when(F.coalesce(F.size(tokens), F.lit(0)) <= 0, "unnamed").when(number & letters, "structured").otherwise("marketing")
    out = df.withColumns({"manufacturer_key": named, "group": kind})
    return out.withColumn("storage_key", F.when(F.col("group") == "structured", _digest([F.col("manufacturer_key"), F.array_join(tokens, " "), F.col("capacity_kwh").cast("long")])))
