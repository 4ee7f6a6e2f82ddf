"""Row-level access: an explicit principal, restriction inherited from documents, and refusals that fail closed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    """Who reads: serving or ingest, and whether restricted rows are allowed; unset means they are hidden."""

    role: str = "serving"
    allow_restricted: bool = False

    def __post_init__(self):
        if self.role not in ("serving", "ingest"):
            raise ValueError("role must be serving or ingest")

    @property
    def sees_restricted(self) -> bool:
        return self.allow_restricted or self.role == "ingest"


def secure(df: DataFrame, principal: Principal, flag: str = "access_restricted") -> DataFrame:
    """The rows that the principal may read or write. Apply it before any ranking or aggregation; a null flag is restricted."""
    return df if principal.sees_restricted else df.where(~F.coalesce(F.col(flag), F.lit(True)))


def inherit(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with access_restricted raised by their document; a chunk without one is an error."""
    parent = documents.select("document_id", F.col("access_restricted").alias("__parent"))
    found = F.coalesce(F.col("__parent"), F.raise_error(F.concat(F.lit("no document "), F.coalesce("document_id", F.lit("null")))).cast("boolean"))
    return chunks.join(parent, "document_id", "left").withColumn("access_restricted", F.col("access_restricted") | found).drop("__parent")


def document_is_restricted(df: DataFrame, documents: DataFrame, out: str = "is_restricted") -> DataFrame:
    """Add whether the row's document is restricted: no document_id means no, an unknown one means yes."""
    known = documents.select("document_id", F.col("access_restricted").alias("__flag"))
    return df.join(known, "document_id", "left").withColumn(out, F.when(F.col("document_id").isNull(), False).otherwise(F.coalesce("__flag", F.lit(True)))).drop("__flag")


def visible_conflicts(conflicts: DataFrame, candidates: DataFrame, claims: DataFrame, documents: DataFrame, principal: Principal) -> DataFrame:
    """Conflicts none of whose candidates comes from a restricted document, unless the principal may see those."""
    if principal.sees_restricted:
        return conflicts
    sources = document_is_restricted(candidates.join(claims.select("claim_id", "document_id"), "claim_id"), documents)
    return conflicts.join(sources.where("is_restricted").select("entry_id"), "entry_id", "left_anti")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and not in the parent; must be empty."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def appended_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of before that after changed or lost; must be empty for an append-only table."""
    return before.exceptAll(after)


def assert_no_overwrite(existing_value: Column, existing_tier: Column, incoming_tier: Column) -> Column:
    return existing_value.isNotNull() & (existing_tier == "system_of_record") & (incoming_tier == "web_supplement")
