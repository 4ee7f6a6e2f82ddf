"""Policy tables: field criticality, review tiers, tolerances, units, manufacturer names. Lookups are broadcast joins of bounded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.plans.schema import CRITICAL, HIGH, INFORMATIONAL, LOW, MEDIUM, VOCABULARIES

# Base severity of each field of the contract.
CRITICALITY = {
    "certifications": CRITICAL,
    "fire_safety_certifications": CRITICAL,
    "cell_certification": CRITICAL,
    "pcs_certification": CRITICAL,
    "ul_listing": CRITICAL,
    "domestic_content_status": CRITICAL,
    "domestic_content_percentage": CRITICAL,
    "baba_status": CRITICAL,
    "baba_certification_ref": CRITICAL,
    "feoc_pfe_status": CRITICAL,
    "country_of_origin": CRITICAL,
    "ercot_compliance_items": CRITICAL,
    "price_per_watt_dc": HIGH,
    "price_per_watt_ac": HIGH,
    "price_per_metre": HIGH,
    "product_warranty_years": HIGH,
    "performance_warranty_years": HIGH,
    "performance_warranty_end_output": HIGH,
    "warranty_years": HIGH,
    "corrosion_warranty_years": HIGH,
    "degradation_warranty_years": HIGH,
    "degradation_warranty_cycles": HIGH,
    "material_assistance_cost_ratio": HIGH,
    "degradation_year_1": HIGH,
    "degradation_annual": HIGH,
    "vector_group": HIGH,
    "nameplate_power": MEDIUM,
    "power_tolerance": MEDIUM,
    "module_efficiency": MEDIUM,
    "stc_rating": MEDIUM,
    "nmot_rating": MEDIUM,
    "temp_coeff_pmax": MEDIUM,
    "temp_coeff_voc": MEDIUM,
    "temp_coeff_isc": MEDIUM,
    "rated_ac_power": MEDIUM,
    "rated_ac_power_temp": MEDIUM,
    "max_efficiency": MEDIUM,
    "cec_efficiency": MEDIUM,
    "trd_percent": MEDIUM,
    "trd_limit_applied": MEDIUM,
    "reactive_capability_at_zero_output": MEDIUM,
    "ride_through_coordination": MEDIUM,
    "automatic_generation_control": MEDIUM,
    "ercot_telemetry": MEDIUM,
    "pmu_support": MEDIUM,
    "rating_mva": MEDIUM,
    "rating_mva_by_cooling": MEDIUM,
    "impedance_percent": MEDIUM,
    "no_load_loss": MEDIUM,
    "load_loss": MEDIUM,
    "efficiency": MEDIUM,
    "ampacity": MEDIUM,
    "usable_energy_per_container": MEDIUM,
    "nameplate_energy_per_container": MEDIUM,
    "power_rating": MEDIUM,
    "c_rate": MEDIUM,
    "round_trip_efficiency": MEDIUM,
    "cycle_life": MEDIUM,
    "energy_density": MEDIUM,
    "footprint_area": MEDIUM,
    "design_wind_speed": MEDIUM,
    "stow_wind_speed": MEDIUM,
    "ground_coverage_ratio": MEDIUM,
    "backtracking_yield_gain": MEDIUM,
    "tracking_range": MEDIUM,
    "bearing_gear_l10_years": MEDIUM,
    "mppt_count": LOW,
    "mppt_voltage_min": LOW,
    "mppt_voltage_max": LOW,
    "harmonic_spectrum": LOW,
    "thd_percent": LOW,
    "k_factor": LOW,
    "filtering_provisions": LOW,
    "dc_injection": LOW,
    "flicker_pst": LOW,
    "flicker_plt": LOW,
    "communication_protocols": LOW,
    "protocols": LOW,
    "cybersecurity_standards": LOW,
    "inverter_integration": LOW,
    "bess_integration": LOW,
    "ride_through_standards": LOW,
    "enclosure_rating": LOW,
    "conductor_size": LOW,
    "conductor_material": LOW,
    "conductor_area": LOW,
    "insulation_type": LOW,
    "shielding": LOW,
    "standards": LOW,
    "cooling_classes": LOW,
    "seismic_qualification": LOW,
    "max_system_voltage": LOW,
    "max_dc_voltage": LOW,
    "voltage_class": LOW,
    "voltage_hv": LOW,
    "voltage_lv": LOW,
    "load_factor": LOW,
    "input_count": LOW,
    "fuse_rating": LOW,
    "continuous_current": LOW,
    "string_monitoring": LOW,
    "surge_protection": LOW,
    "disconnect_type": LOW,
    "chemistry": LOW,
    "thermal_management": LOW,
    "augmentation_plan": LOW,
    "cell_technology": LOW,
    "bifaciality_factor": LOW,
    "bifaciality_tolerance": LOW,
    "topology": LOW,
    "configuration": LOW,
    "modules_per_row": LOW,
    "galvanization_spec": LOW,
    "foundations_per_mw": LOW,
    "supplier": INFORMATIONAL,
    "supplier_verbatim": INFORMATIONAL,
    "model": INFORMATIONAL,
    "model_verbatim": INFORMATIONAL,
    "component_category": INFORMATIONAL,
    "datasheet_revision": INFORMATIONAL,
    "datasheet_date": INFORMATIONAL,
    "stow_strategy": INFORMATIONAL,
    "support_terms": INFORMATIONAL,
    "plant_controller_model": INFORMATIONAL,
}
# Review tiers; every other field is in DEFAULT_TIER.
TIERS = {
    "price_per_watt_ac": "a",
    "price_per_watt_dc": "a",
    "price_per_metre": "a",
    "product_warranty_years": "a",
    "performance_warranty_years": "a",
    "performance_warranty_end_output": "a",
    "corrosion_warranty_years": "a",
    "warranty_years": "a",
    "degradation_year_1": "a",
    "degradation_annual": "a",
    "degradation_warranty_years": "a",
    "degradation_warranty_cycles": "a",
    "domestic_content_percentage": "a",
    "domestic_content_status": "a",
    "country_of_origin": "a",
    "material_assistance_cost_ratio": "a",
    "baba_status": "a",
    "baba_certification_ref": "a",
    "feoc_pfe_status": "a",
    "certifications": "a",
    "cell_certification": "a",
    "pcs_certification": "a",
    "fire_safety_certifications": "a",
    "ul_listing": "a",
    "standards": "a",
    "ride_through_standards": "a",
    "cybersecurity_standards": "a",
    "seismic_qualification": "a",
    "nameplate_power": "b",
    "stc_rating": "b",
    "nmot_rating": "b",
    "module_efficiency": "b",
    "rated_ac_power": "b",
    "cec_efficiency": "b",
    "usable_energy_per_container": "b",
    "nameplate_energy_per_container": "b",
    "round_trip_efficiency": "b",
    "cycle_life": "b",
    "rating_mva": "b",
    "no_load_loss": "b",
    "load_loss": "b",
    "impedance_percent": "b",
}
# Tolerances as (field, rule, magnitude, alternate condition, alternate magnitude).
TOLERANCES = [
    ("nameplate_power", "absolute", 1.0, None, None),
    ("stc_rating", "absolute", 1.0, None, None),
    ("nmot_rating", "absolute", 1.0, None, None),
    ("module_efficiency", "absolute", 0.1, None, None),
    ("temp_coeff_pmax", "absolute", 0.01, None, None),
    ("temp_coeff_voc", "absolute", 0.01, None, None),
    ("temp_coeff_isc", "absolute", 0.005, None, None),
    ("degradation_year_1", "absolute", 0.05, None, None),
    ("degradation_annual", "absolute", 0.05, None, None),
    ("max_efficiency", "absolute", 0.05, None, None),
    ("cec_efficiency", "absolute", 0.1, "against_cec_list", 0.25),
    ("efficiency", "absolute", 0.05, None, None),
    ("round_trip_efficiency", "absolute", 0.2, None, None),
    ("rated_ac_power", "relative", 0.01, None, None),
    ("impedance_percent", "relative", 0.075, "impedance_below_10_pct", 0.10),
    ("usable_energy_per_container", "relative", 0.005, None, None),
    ("nameplate_energy_per_container", "relative", 0.005, None, None),
    ("no_load_loss", "one_sided", 0.15, None, None),
    ("load_loss", "one_sided", 0.15, None, None),
    ("power_tolerance", "declared_band", None, None, None),
    ("bifaciality_tolerance", "declared_band", None, None, None),
    ("max_system_voltage", "exact", None, None, None),
    ("rating_mva", "exact", None, None, None),
    ("cycle_life", "exact", None, None, None),
]
# Units as family and factor.
UNITS = {
    "w": ("w", 1.0), "kw": ("w", 1e3), "mw": ("w", 1e6), "gw": ("w", 1e9),
    "va": ("va", 1.0), "kva": ("va", 1e3), "mva": ("va", 1e6),
    "wh": ("wh", 1.0), "kwh": ("wh", 1e3), "mwh": ("wh", 1e6), "gwh": ("wh", 1e9),
    "v": ("v", 1.0), "kv": ("v", 1e3), "a": ("a", 1.0), "ka": ("a", 1e3),
    "usd/w": ("usd/w", 1.0), "usd/kw": ("usd/w", 1e-3), "%": ("%", 1.0), "fraction": ("%", 100.0),
}
# Legal forms that end a company's name, names of one company, suffix rules, equal names of tokens.
LEGAL_FORMS = (
    "co",
    "company",
    "corp",
    "corporation",
    "inc",
    "incorporated",
    "ltd",
    "limited",
    "llc",
    "lp",
    "llp",
    "plc",
    "gmbh",
    "ag",
    "kg",
    "bv",
    "nv",
    "sa",
    "sas",
    "srl",
    "spa",
    "ab",
    "as",
    "oy",
    "oyj",
    "aps",
    "pty",
    "kk",
    "sdn",
    "bhd",
    "pte",
    "jsc",
    "ojsc",
    "pjsc",
)
MANUFACTURER_ALIASES = {"hanwha q cells": "qcells", "q cells": "qcells", "csi solar": "canadian solar", "neo solar power": "united renewable energy"}
SUFFIX_RULES = {("rec solar", "blk"): "safe", ("maxeon solar technologies", "blk"): "never_strip"}
TOKEN_ALIASES = {"ansi": "ieee", "ansi/ieee": "ieee", "ieee/ansi": "ieee", "euro": "european", "eu": "european"}
# Words in the names of fields that look as if they belong to tier a.
TIER_A_PATTERN = "price|warrant|degradation_year_1|degradation_annual|domestic_content|country_of_origin|material_assistance|baba|feoc|cert|listing|standards|seismic_qualification"
# How far sources are trusted for information, the most first; the order never resolves a conflict.
SOURCE_AUTHORITY_ORDER = (
    "manufacturer_datasheet",
    "ul_tuv_intertek",
    "ieee_nfpa",
    "ercot_puct_tceq",
    "irs_treasury",
)
RULES, ALTERNATES = VOCABULARIES["tolerance_rule"], ("impedance_below_10_pct", "regime_ieee", "against_cec_list")
DEFAULT_CRITICALITY, DEFAULT_TIER = CRITICAL, "b"
#: Fields that must never be compared; empty, as no field is known to be one.
NEVER_COMPARABLE: tuple[str, ...] = ()


def check_tolerances(rows=TOLERANCES) -> None:
    """Numeric rules need a magnitude of at least 0, the others none; alternates come in pairs."""
    for field, rule, magnitude, when, alternate in rows:
        numeric = rule in ("absolute", "relative", "one_sided")
        if numeric != (magnitude is not None) or (magnitude or 0) < 0 or (when is None) != (alternate is None):
            raise ValueError(f"tolerance row of {field} is inconsistent")


def policy(spark) -> DataFrame:
    """One row a field that any table names: rule, magnitude, alternates, criticality, tier. About 130 rows."""
    check_tolerances()
    crit, tier, tol = CRITICALITY, TIERS, {t[0]: t[1:] for t in TOLERANCES}
    fields = sorted({*crit, *tier, *tol, *NEVER_COMPARABLE})
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows = [(f, *(("never_compare", None, None, None) if f in NEVER_COMPARABLE else tol.get(f, ("exact", None, None, None))), crit.get(f, DEFAULT_CRITICALITY), tier.get(f, DEFAULT_TIER)) for f in fields]
    listed = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    # Literal rows are a local relation of the plan: no job and no Python worker reads them.
    rows = spark.sql(f"SELECT field_name, rule, CAST(magnitude AS DOUBLE) AS magnitude, CAST(alternate_when AS STRING) AS alternate_when, CAST(alternate_magnitude AS DOUBLE) AS alternate_magnitude, CAST(criticality AS INT) AS criticality, tier FROM VALUES {listed} AS t(field_name, rule, magnitude, alternate_when, alternate_magnitude, criticality, tier)")
    return rows.withColumns({"rule_no": _number("rule", RULES), "alternate_no": _number("alternate_when", ALTERNATES)})


def _number(column: str, names: tuple[str, ...]) -> Column:
    """The place of a column's text in names, which pairs compare faster than the text; null for null."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in names]), F.col(column)) - 1, F.lit(-1)).cast("int")


def with_policy(df: DataFrame) -> DataFrame:
    """Add rule, magnitude, alternates, criticality and tier by field_name; unknown fields get the defaults."""
    p = policy(df.sparkSession)
    out = df.join(F.broadcast(p), "field_name", "left")
    return out.withColumns({"rule": F.coalesce("rule", F.lit("exact")), "rule_no": F.coalesce("rule_no", F.lit(RULES.index("exact"))), "criticality": F.coalesce("criticality", F.lit(DEFAULT_CRITICALITY)), "tier": F.coalesce("tier", F.lit(DEFAULT_TIER))})


def looks_tier_a(field_name: Column) -> Column:
    return field_name.rlike(TIER_A_PATTERN)


def unit_base(unit: Column) -> Column:
    """struct(family, factor) of a unit, null for an unknown one."""
    table = F.create_map(*[x for u, (f, k) in UNITS.items() for x in (F.lit(u), F.struct(F.lit(f).alias("family"), F.lit(k).alias("factor")))])
    return F.try_element_at(table, F.lower(F.trim(unit)))
