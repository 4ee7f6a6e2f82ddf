"""Claims to canonical fields: deduplication, contradictions, projection by condition, and the guards of a commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.operators.conflicts import COMPONENT, condition_key
from concordia.plans.schema import RECORD, WEB

#: The natural key of a claim: component, source and field, with the condition.
NATURAL_KEY = ("document_id", *COMPONENT, "nameplate", "field_name", "extractor_version", "condition_text")


def with_condition_text(claims: DataFrame) -> DataFrame:
    return claims.withColumn("condition_text", F.to_json(condition_key(F.col("condition"))))


def provenance() -> Column:
    """The source reference stamped with the claim's extractor version."""
    return F.col("source_ref").withField("extractor_version", F.col("extractor_version"))


def as_candidates(claims: DataFrame) -> DataFrame:
    """Claims as conflict candidates: component, field, value and its provenance."""
    return claims.select(*COMPONENT, "field_name", "document_id", "value", "unit", "verbatim_value", "condition", "source_tier", provenance().alias("source_ref"), "confidence", "extractor_version")


def canonical_claims(claims: DataFrame) -> DataFrame:
    """One row for each claim's full content; note and derived don't count, the least note survives.

    Columns of the identity are the keys themselves, and only what they don't tell is carried beside them. Claims go to
    their keys' partition before they are sorted, so that each is written once and none is sorted or spilled before.
    """
    c = with_condition_text(claims)
    own = [*NATURAL_KEY, "source_tier", "source_ref", "confidence"]
    derived = {"__canon": F.col("value.canon"), "__unit": F.coalesce("unit", F.lit("")), "__verbatim": F.coalesce("verbatim_value", F.lit(""))}
    rest = [x for x in c.columns if x not in own]
    slim = c.select(*own, F.struct(*rest).alias("__rest"), F.coalesce("condition.note", F.lit("")).alias("__note"), *[f.alias(n) for n, f in derived.items()])
    keys = [*own, *derived]
    kept = slim.repartition(*keys).groupBy(*keys).agg(F.min_by("__rest", "__note").alias("__rest"))
    return kept.select(*[x if x in own else F.col("__rest")[x].alias(x) for x in c.columns])


def contradictions(claims: DataFrame) -> DataFrame:
    """Natural keys under which claims assert more than one (value, unit); must be empty before a projection."""
    asserted = F.struct(F.coalesce("value.canon", F.lit("None")).alias("canon"), F.coalesce("unit", F.lit("")).alias("unit"))
    return with_condition_text(claims).groupBy(*NATURAL_KEY).agg(F.count_distinct(asserted).alias("n_asserted")).where("n_asserted > 1")


def project(claims: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name")) -> DataFrame:
    """One canonical field for each key and exact condition: the preferred claim's columns, n_claims and conflict_status.

    Preferred are record over web, a value over none, then confidence, then the claim's content. The status is open when
    claims of all tiers, gaps included, give more than one answer. One aggregation, so a hot field is combined map-side.
    """
    c = with_condition_text(claims)
    preference = F.struct((F.col("source_tier") != RECORD).alias("a"), F.col("value").isNull().alias("b"), (-F.col("confidence")).alias("c"), F.col("document_id").alias("d"), F.col("extractor_version").alias("e"), F.coalesce("value.canon", F.lit("None")).alias("f"), F.coalesce("unit", F.lit("")).alias("g"), F.coalesce("verbatim_value", F.lit("")).alias("h"), F.xxhash64(F.to_json("source_ref")).alias("i"))
    answer = F.struct(F.coalesce("value.canon", F.lit("None")).alias("canon"), F.coalesce("unit", F.lit("")).alias("unit"))
    rest = [x for x in claims.columns if x not in (*keys, "condition_text")]
    # Least and greatest answer differ exactly when there are several; unlike a distinct count this needs no expansion.
    grouped = c.groupBy(*keys, "condition_text").agg(F.min_by(F.struct(*rest), preference).alias("best"), F.min(answer).alias("lo"), F.max(answer).alias("hi"), F.count(F.lit(1)).alias("n_claims"))
    return grouped.select(*keys, "condition_text", "best.*", "n_claims", F.when(F.col("lo") == F.col("hi"), "none").otherwise("open").alias("conflict_status"))


def preferred(claims: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name")) -> DataFrame:
    """The preferred claim of each key and condition by a window, with rank for those that want the runners-up."""
    w = Window.partitionBy(*keys, "condition_text").orderBy(F.col("source_tier") != RECORD, F.col("value").isNull(), F.desc("confidence"), "document_id", "extractor_version", "value.canon")
    return with_condition_text(claims).withColumn("rank", F.row_number().over(w))


def lost_groups(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name")) -> DataFrame:
    """Stored (key, condition) groups of touched keys with a value that the incoming fields don't cover; must be empty."""
    touched = stored.join(incoming.select(*keys).distinct(), list(keys), "left_semi").where("value is not null")
    return touched.join(incoming.select(*keys, "condition_text").distinct(), [*keys, "condition_text"], "left_anti")


def overwrites(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name")) -> DataFrame:
    """Incoming web values that would replace a stored record value; must be empty."""
    old = stored.where((F.col("source_tier") == RECORD) & F.col("value").isNotNull()).select(*keys, "condition_text")
    return incoming.where(F.col("source_tier") == WEB).join(old, [*keys, "condition_text"], "left_semi")


class CommitRefusedError(ValueError):
    """A commit would contradict itself, lose a stored value or overwrite a record by web content."""


def commit(stored: DataFrame, claims: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name")) -> DataFrame:
    """The store after claims replace the fields they touch; raises CommitRefusedError when a guard finds a row.

    Nothing is written here: the caller, the one holder of the store, writes the result. No claims, no change.
    """
    incoming = project(canonical_claims(claims), keys)
    for guard, name in ((contradictions(claims), "contradicting claims"), (lost_groups(stored, incoming, keys), "lost stored values"), (overwrites(stored, incoming, keys), "web over record")):
        if not guard.isEmpty():
            raise CommitRefusedError(name)
    kept = stored.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def resolutions_first(resolutions: DataFrame) -> DataFrame:
    """The first resolution of each conflict; later ones are refused, as a resolution is written once."""
    return resolutions.groupBy("entry_id").agg(F.min_by(F.struct(*[c for c in resolutions.columns if c != "entry_id"]), F.struct("resolved_at", "resolution_id")).alias("r")).select("entry_id", "r.*")


def gaps(components: DataFrame, contract: DataFrame, claims: DataFrame) -> DataFrame:
    """Fields that the contract requires of a component's category and for which no record claim has a value."""
    need = components.select(*COMPONENT).distinct().join(F.broadcast(contract.select("component_category", "field_name")), "component_category")
    have = claims.where((F.col("source_tier") == RECORD) & F.col("value").isNotNull()).select(*COMPONENT, "field_name")
    return need.join(have, [*COMPONENT, "field_name"], "left_anti").select(*COMPONENT, "field_name")


def default_conditions(claims: DataFrame, implied: dict[str, dict[str, object]], convention: dict[str, object], never: tuple[str, ...] = ()) -> DataFrame:
    """Fill unstated dimensions from what a field implies, then by convention; filled ones are recorded in derived."""
    cond = F.col("condition")
    changes, filled = {}, []
    for d in sorted({*convention, *(x for m in implied.values() for x in m)}):
        if d in never:
            continue
        by_field = F.lit(None)
        for name, m in implied.items():
            if d in m:
                by_field = F.when(F.col("field_name") == name, F.lit(m[d])).otherwise(by_field)
        value = F.coalesce(cond[d], by_field, F.lit(convention.get(d)))
        changes[d] = value
        filled.append(F.when(cond[d].isNull() & value.isNotNull(), F.lit(d)))
    out = cond
    for d, v in changes.items():
        out = out.withField(d, v)
    derived = F.array_sort(F.array_distinct(F.concat(F.coalesce(cond["derived"], F.array().cast("array<string>")), F.array_compact(F.array(*filled)))))
    return claims.withColumn("condition", out.withField("derived", derived)) if changes else claims


def ensemble(readings: list[DataFrame]) -> DataFrame:
    """Claims of several extractors by union, never by vote: whatever any of them asserts stands, once."""
    out = readings[0]
    for r in readings[1:]:
        out = out.unionByName(r)
    return canonical_claims(out)


def is_missing() -> Column:
    return F.col("value").isNull()


def is_web_supplemented() -> Column:
    return F.col("source_tier") == WEB


def field_checks() -> dict[str, Column]:
    """What a stored field must satisfy: a resolved one has its resolution, and its status is known."""
    return {"resolved_has_resolution": (F.col("conflict_status") != "resolved") | F.col("resolution").isNotNull(), "conflict_status": F.col("conflict_status").isin("none", "open", "resolved", "insufficient_evidence")}


# Names of parameters that stand for the store's writer, and its type.
WRITE_HANDLES, WRITER_TYPE = ("writer", "store", "storage", "claim_writer"), "ClaimWriter"


def takes_a_write_handle(f) -> bool:
    """Whether a function's signature asks for the store's writer, by name or by annotation; only the commit step may."""
    import inspect

    return any(name in WRITE_HANDLES or WRITER_TYPE in str(p.annotation) for name, p in inspect.signature(f).parameters.items())
