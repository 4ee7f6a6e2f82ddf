"""Row types, closed vocabularies and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BAND = "struct<low:double,high:double,kind:string,unit:string>"
VALUE = f"struct<kind:string,num:double,is_int:boolean,txt:string,flag:boolean,items:array<string>,entries:map<string,string>,band:{BAND},canon:string>"
CONDITION = "struct<basis:string,temperature_c:double,side:string,duration_h:double,weighting:string,standards_regime:string,reference_temperature_c:double,rte_boundary:string,tap_position_pct:double,base_mva:double,note:string,derived:array<string>>"
SOURCE_REF = "struct<document_id:string,page:int,section:string,extractor_version:string,bounding_box:struct<x0:double,y0:double,x1:double,y1:double>,url:string,page_title:string,retrieved_at:timestamp,source_authority:string>"
CLAIM = f"document_id string, component_category string, supplier string, model string, nameplate double, field_name string, extractor_version string, condition {CONDITION}, value {VALUE}, unit string, verbatim_value string, source_tier string, source_ref {SOURCE_REF}, confidence double, extracted_at timestamp"
EVENT = "stream string, document_id string, seq bigint, prev_hash string, hash string, event_type string, actor string, payload_canonical string, recorded_at timestamp"
JOB = "job_id bigint, document_id string, stage string, status string, idempotency_key string, payload string, attempt int, max_attempts int, next_attempt_at timestamp, lease_owner string, lease_expires_at timestamp, last_error string, created_at timestamp, updated_at timestamp"

# The dimensions of a condition, in the order in which they are compared and grouped.
DIMENSIONS = ("basis", "temperature_c", "side", "duration_h", "weighting", "standards_regime", "reference_temperature_c", "rte_boundary", "tap_position_pct", "base_mva")
RECORD, WEB = "system_of_record", "web_supplement"
# What a claim, a conflict and a job may hold.
VOCABULARIES = {
    "source_tier": (RECORD, WEB),
    "conflict_class": ("record_vs_web", "intra_document", "inter_document", "unit_normalization", "temporal"),
    "conflict_status": ("none", "open", "resolved", "insufficient_evidence"),
    "tolerance_rule": ("exact", "absolute", "relative", "one_sided", "declared_band", "never_compare"),
    "tolerance_kind": ("absolute", "relative"),
    "tier": ("a", "b", "c"),
    "job_status": ("pending", "running", "succeeded", "failed", "quarantined"),
    "chunk_kind": ("prose", "table_full", "table_row", "table_summary"),
    "document_type": ("contract_tos", "purchase_order", "environmental_regulation", "terms_and_conditions", "warranty", "technical_documentation", "pricing", "spec_sheet"),
    "resolution_action": ("select_value", "enter_override", "keep_system_of_record", "request_more_web_search", "defer"),
    "cell_flag": ("unresolved_conflict", "web_supplemented", "low_confidence", "missing_data"),
    "queue_status": ("pending", "leased", "resolved"),
}
SEVERITIES = ("informational", "low", "medium", "high", "critical")
INFORMATIONAL, LOW, MEDIUM, HIGH, CRITICAL = range(5)


@dataclass(frozen=True)
class Settings:
    """Policy knobs with their bounds; a value out of bounds is refused."""

    gate_severity_threshold: int = MEDIUM
    target_precision_auto_accepted: float = 0.99
    review_budget_fraction: float = 0.20
    chunk_size_tokens: int = 512
    chunk_overlap_ratio: float = 0.05
    max_concurrent_parse: int = 4
    max_concurrent_llm: int = 8
    web_search_rate_limit_per_minute: int = 30

    def __post_init__(self):
        bounds = {"gate_severity_threshold": (INFORMATIONAL, HIGH), "target_precision_auto_accepted": (0, 1), "review_budget_fraction": (0, 1), "chunk_size_tokens": (1, 1 << 31), "chunk_overlap_ratio": (0, 0.10), "max_concurrent_parse": (1, 1 << 31), "max_concurrent_llm": (1, 1 << 31), "web_search_rate_limit_per_minute": (1, 1 << 31)}
        for name, (low, high) in bounds.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")


def finite(x: Column) -> Column:
    """x with -0.0 folded to 0.0; null where it isn't finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x + F.lit(0.0))


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails; a null check is a failure. An empty array means a valid row."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def claim_checks() -> dict[str, Column]:
    """What every claim row must satisfy before it is appended."""
    ref, band = F.col("source_ref"), F.col("value.band")
    number = F.col("value.num")
    return {
        "source_identified": ref["document_id"].isNotNull() | ref["url"].isNotNull(),
        "source_tier": F.col("source_tier").isin(*VOCABULARIES["source_tier"]),
        "confidence": F.col("confidence").between(0, 1),
        "finite_value": number.isNull() | finite(number).isNotNull(),
        "band_shape": band.isNull() | (band["low"].isNotNull() & band["high"].isNotNull() & (band["low"] <= band["high"]) & band["kind"].isin(*VOCABULARIES["tolerance_kind"]) & (finite(band["low"]) + finite(band["high"])).isNotNull()),
        "finite_nameplate": F.col("nameplate").isNull() | finite(F.col("nameplate")).isNotNull(),
        "finite_condition": F.forall(F.array(*[F.col(f"condition.{d}") for d in DIMENSIONS if d.endswith(("_c", "_h", "_pct", "_mva"))]), lambda x: x.isNull() | finite(x).isNotNull()),
    }


def quarantine(df, checks: dict[str, Column]):
    """(valid rows, refused rows with error_class), from one pass of checks each."""
    marked = df.withColumn("error_class", violations(checks))
    return marked.where(F.size("error_class") == 0).drop("error_class"), marked.where(F.size("error_class") > 0)
