"""Candidates to graded conflicts: comparable pairs, the verdict on each, its severity, and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions import text, values
from concordia.plans import policy
from concordia.plans.policy import ALTERNATES, RULES
from concordia.plans.schema import CRITICAL, DIMENSIONS, HIGH, RECORD

COMPONENT = ("component_category", "supplier", "model")


def comparable(a: Column, b: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """Whether two conditions may be compared: no dimension that both state differs. Symmetric, not transitive."""
    out = F.lit(True)
    for d in dimensions:
        out = out & F.coalesce(a[d] == b[d], F.lit(True))
    return out


def is_unstated(c: Column) -> Column:
    return F.coalesce(*[c[d].cast("string") for d in DIMENSIONS]).isNull()


def condition_key(c: Column) -> Column:
    """The dimensions of a condition as one groupable value; note and derived don't count."""
    return F.struct(*[c[d].alias(d) for d in DIMENSIONS])


def prepare(claims: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """What comparison needs of each claim, computed once a row and not once a pair.

    Adds kind, num and canon of the value, its unit's family and the number in the family's base unit (scaled), ord (a total order of distinct claims), fold (folded text), base and year (text without and with its edition),
    unit_fold, floor (half of the last
    printed digit). ascii_only keeps all in SQL functions, for text known to be ASCII.
    """
    f = text.collapse if ascii_only else text.fold
    folded = claims.withColumns({"fold": f(F.col("value.txt")), "unit_fold": f(F.col("unit"))})
    base, year = text.edition(F.col("fold"))
    ref, unit = F.col("source_ref"), policy.unit_base(F.col("unit"))
    order = F.struct(F.col("source_tier"), F.col("document_id"), F.col("value.canon").alias("canon"), F.col("unit"), F.col("extractor_version"), F.xxhash64(F.to_json(F.struct("condition", "verbatim_value", "source_ref", "confidence"))).alias("h"))
    return folded.withColumns({"base": base, "year": year, "floor": F.lit(0.5) * F.pow(F.lit(10.0), -values.printed_decimals(F.col("verbatim_value"), F.col("value.num"), F.col("value.is_int"), F.col("value.canon")).cast("double")), "family": unit["family"], "scaled": F.col("value.num") * unit["factor"], "kind": F.col("value.kind"), "num": F.col("value.num"), "canon": F.col("value.canon"), "source_id": F.coalesce(ref["document_id"], ref["url"]), "record": F.col("source_tier") == RECORD, "ieee": F.coalesce(F.col("condition.standards_regime") == "ieee", F.lit(False)), "against_cec_list": F.coalesce(F.contains(F.lower(ref["source_authority"]), F.lit("cec")), F.lit(False)), "ord": order})


def comparison_pairs(candidates: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name"), *, order: str = "ord", condition: str = "condition", dimensions: tuple[str, ...] = DIMENSIONS, flat: bool = False) -> DataFrame:
    """Every unordered pair of comparable candidates of one key, once: keys, l, r (structs of the other columns), or with
    flat their columns by themselves, with l_ and r_ before their names.

    A self-join on the keys with the order and the condition test as residual predicates. Pairs are the result, so their
    number is the operator's own. Null keys never meet.
    """
    rest = [c for c in candidates.columns if c not in keys]
    left, right = (candidates.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in rest]) for side in "lr")
    pairs = left.join(right, list(keys)).where((F.col(f"l_{order}") < F.col(f"r_{order}")) & comparable(F.col(f"l_{condition}"), F.col(f"r_{condition}"), dimensions))
    return pairs if flat else pairs.select(*keys, *[_side(side, rest) for side in "lr"])


def _side(side: str, columns: list[str]) -> Column:
    return F.struct(*[F.col(f"{side}_{c}").alias(c) for c in columns]).alias(side)


def comparison_groups(candidates: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name")) -> DataFrame:
    """Candidates by exact condition, for display: keys, condition_key, members in order. Not for detection."""
    rest = [c for c in candidates.columns if c not in (*keys, "condition")]
    members = F.collect_list(F.struct("ord", *[c for c in rest if c != "ord"]))
    by_ord = lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
    return candidates.groupBy(*keys, condition_key(F.col("condition")).alias("condition_key")).agg(F.array_sort(members, by_ord).alias("members"))


def conflict_class(l: Column, r: Column) -> Column:  # noqa: E741
    return F.when(l["record"] != r["record"], "record_vs_web").when(l["source_id"].eqNullSafe(r["source_id"]), "intra_document").otherwise("inter_document")


def resolve_band(nominal: Column, band: Column) -> tuple[Column, Column]:
    """The interval that a declared band guarantees around a nominal value; a missing band is a point.

    A percentage is multiplied before it is divided by 100, which gives 33 % above 902 as 1199.66 and not as 1199.6599999999999.
    """
    away = lambda x: F.when(band["kind"] == "relative", nominal * x / 100.0).otherwise(x)
    a, b = F.coalesce(nominal + away(band["low"]), nominal), F.coalesce(nominal + away(band["high"]), nominal)
    return F.least(a, b), F.greatest(a, b)


#: What a side holds.
NOTHING, NUMBER, TEXT, OTHER = range(4)
#: How a pair was judged; CONFLICTING are the codes of conflicts.
GAP, UNITS, TEXTS_DIFFER, EDITIONS, TEXTS_AGREE, EQUAL, UNLIKE, BEYOND, WITHIN = range(9)
CONFLICTING = (UNITS, TEXTS_DIFFER, EDITIONS, UNLIKE, BEYOND)
REASONS = ("one side has no value", "units differ", "texts differ", "editions differ", "texts agree", "values are equal", "values are neither numbers nor texts alike", "numbers differ by more than the tolerance and the printed precision", "numbers agree within the tolerance or the printed precision")


def compared_policy(df: DataFrame) -> DataFrame:
    """What pairs and sets read of their field's policy, as numbers and flags that are never null."""
    critical = F.when(F.col("criticality") == CRITICAL, F.lit(CRITICAL)).otherwise(F.lit(0))
    return df.withColumns({
        "plain": F.coalesce("magnitude", F.lit(0.0)),
        "other": F.coalesce("alternate_magnitude", F.lit(0.0)),
        "numeric": F.col("magnitude").isNotNull(),
        "scales": F.col("rule_no").isin(RULES.index("relative"), RULES.index("one_sided")),
        "least_grade": F.greatest(critical, F.when(F.col("tier") == "a", F.lit(HIGH)).otherwise(F.lit(0))),
    })


def compared(ready: DataFrame) -> DataFrame:
    """What the verdict and the grade of a pair derive from one side and its field's policy, computed once a claim.

    Numbers and flags that are never null keep the expression on a pair short: the JVM doesn't compile a method of more
    than 8,000 bytes of code, and interpreting it costs a pair many times as much.
    """
    no, alternate = F.lit(False), F.col("alternate_no")
    on = lambda name: alternate == ALTERNATES.index(name)
    return compared_policy(ready).withColumns({
        "form": F.when(F.col("kind").isNull(), F.lit(NOTHING)).when(F.col("num").isNotNull(), F.lit(NUMBER)).when(F.col("kind") == "text", F.lit(TEXT)).otherwise(F.lit(OTHER)),
        "x": F.coalesce("num", F.lit(0.0)),
        "scaled_x": F.coalesce("scaled", F.lit(0.0)),
        "known": F.col("num").isNotNull(),
        "any_alternate": F.coalesce((on("regime_ieee") & F.col("ieee")) | (on("against_cec_list") & F.col("against_cec_list")), no),
        "all_alternate": F.coalesce(on("impedance_below_10_pct") & (F.abs("num") < 10), no),
        "many": F.coalesce(F.col("distinct_values") >= 3, no),
    })


def judge(l: dict[str, Column], r: dict[str, Column], band_l: Column | None = None, band_r: Column | None = None) -> Column:  # noqa: E741
    """The code of a pair of comparable candidates; the first rule that applies decides. l and r are columns of compared();
    rule_no, plain and other are the pair's own.

    Gaps never conflict, different units always do, texts are compared folded and by edition, numbers by the field's
    tolerance or the precision with which they were printed, whichever is wider. A field that must never be compared
    raises an error.
    """
    a, b, no, rule = l["x"], r["x"], F.lit(False), F.col("rule_no")
    floor = F.greatest(l["floor"], r["floor"])
    selected = l["any_alternate"] | r["any_alternate"] | (l["all_alternate"] & r["all_alternate"])
    wide = F.when(selected, F.col("other")).otherwise(F.col("plain"))
    is_rule = lambda name: rule == RULES.index(name)
    # One-sided: how far the measured number exceeds the declared one; two records, or two of the web, by the print alone.
    against = is_rule("one_sided") & ~F.coalesce(l["record"] == r["record"], no)
    declared, measured = F.when(l["record"], a).otherwise(b), F.when(l["record"], b).otherwise(a)
    gap = F.when(against, measured - declared).otherwise(F.abs(a - b))
    scale = F.when(is_rule("relative"), F.greatest(F.abs(a), F.abs(b))).when(against, F.abs(declared)).when(is_rule("one_sided") | is_rule("declared_band"), F.lit(0.0)).otherwise(F.lit(1.0))
    beyond = gap > F.greatest(wide * scale, floor)
    if band_l is not None and band_r is not None:
        (l_low, l_high), (r_low, r_high) = resolve_band(a, band_l), resolve_band(b, band_r)
        beyond = F.when(is_rule("declared_band") & (band_l.isNotNull() | band_r.isNotNull()), ~((l_low <= r_high) & (r_low <= l_high))).otherwise(beyond)
    both = lambda form: (l["form"] == form) & (r["form"] == form)
    return (
        F.when(is_rule("never_compare"), F.raise_error(F.lit("this field must never be compared")).cast("int"))
        .when((l["form"] == NOTHING) | (r["form"] == NOTHING), GAP)
        .when(F.coalesce(l["unit_fold"] != r["unit_fold"], no), UNITS)
        .when(both(NUMBER), F.when(beyond, BEYOND).otherwise(WITHIN))
        .when(both(TEXT), F.when(l["base"] != r["base"], TEXTS_DIFFER).when(F.coalesce(l["year"] != r["year"], no), EDITIONS).otherwise(TEXTS_AGREE))
        .when((l["form"] != NUMBER) & (r["form"] != NUMBER) & (l["canon"] == r["canon"]), EQUAL)
        .otherwise(UNLIKE)
    )


def told(code: Column, l: Column, r: Column) -> dict[str, Column]:  # noqa: E741
    """conflicts, conflict_class and reason of a code, each an expression of its own, so unused ones cost nothing."""
    yes = code.isin(*CONFLICTING)
    kind = F.when(code == UNITS, "unit_normalization").when(code == EDITIONS, "temporal").when(yes, conflict_class(l, r))
    return {"conflicts": yes, "conflict_class": kind, "reason": F.element_at(F.array(*[F.lit(x) for x in REASONS]), code + 1)}


def graded(pairs: DataFrame, l: dict[str, Column], r: dict[str, Column]) -> DataFrame:  # noqa: E741
    """Add severity to judged pairs (code, and of compared() rule_no, plain, scales, numeric, criticality, least_grade), null
    where there is no conflict: 0 (informational) to 4 (critical). l and r hold x, scaled_x, known, family, record, many.

    It is the field's base, +1 for a gross divergence, for two records that disagree and for three or more values under
    one condition, -2 for units that reconcile; tier A is at least high, a critical field critical. It is computed in
    steps of a few columns: one expression of it all would be too large a method for the JVM to compile.
    """
    no = F.lit(False)
    p = pairs.withColumn("__family", F.coalesce(l["family"] == r["family"], no))
    side = lambda x: F.when(F.col("__family"), x["scaled_x"]).otherwise(x["x"])
    p = p.withColumns({"__x": side(l), "__y": side(r), "__present": l["known"] & r["known"]})
    x, y = F.col("__x"), F.col("__y")
    p = p.withColumns({"__low": F.least(x, y), "__high": F.greatest(x, y), "__band": F.when(F.col("scales"), F.col("plain") * F.greatest(F.abs(x), F.abs(y))).otherwise(F.col("plain"))})
    low, high, band, present = (F.col(c) for c in ("__low", "__high", "__band", "__present"))
    gross = F.when(band > 0, high - low >= 10 * band).when(low > 0, high / low >= 10).otherwise(no)
    within = F.when(F.col("numeric"), high - low <= band).otherwise((F.col("rule_no") == RULES.index("exact")) & values.close(low, high))
    kind = F.col("conflict_class")
    p = p.withColumns({"__gross": present & gross, "__units": F.coalesce((kind == "unit_normalization") & F.col("__family") & present & within, no), "__records": F.coalesce(l["record"] & r["record"] & (kind == "inter_document"), no), "__many": l["many"] | r["many"]})
    points = lambda c, n: F.when(F.col(c), F.lit(n)).otherwise(F.lit(0))
    total = F.col("criticality") + points("__gross", 1) + points("__records", 1) + points("__many", 1) + points("__units", -2)
    grade = F.greatest(F.least(F.lit(CRITICAL), total), F.lit(0), F.col("least_grade")).cast("int")
    return p.withColumn("severity", F.when(F.col("conflicts"), grade))


def value_counts(candidates: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name")) -> DataFrame:
    """Distinct non-null values under each exact condition of a key; 1, 1.0 and true are one value, units don't count."""
    v = F.col("value")
    same = F.coalesce(v["num"].cast("string"), v["flag"].cast("double").cast("string"), v["canon"])
    ck = F.to_json(condition_key(F.col("condition")))
    return candidates.groupBy(*keys, ck.alias("condition_text")).agg(F.count_distinct(same).alias("distinct_values"))


def gathered(claims: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name"), *, ascii_only: bool = False, bands: DataFrame | None = None) -> DataFrame:
    """prepare()d claims with their condition_text, stated (the dimensions alone), band, distinct_values (see value_counts) and copies
    (how many claims of the key have its ord, itself included), all claims of a key in one place.

    Claims are shuffled once, by their keys alone. What follows, counts and pairs, finds them in place: both sides of the
    pairs read the same shuffle, as what their field's policy adds is looked up after it. Dimensions are shuffled as
    columns, since the planner prunes structs on each side by itself, which makes two shuffles. Rows without a key, which
    never meet another, are left out.
    """
    known = claims.where(" and ".join(f"`{k}` is not null" for k in keys))
    ready = prepare(known, ascii_only=ascii_only).withColumns({"condition_text": F.to_json(condition_key(F.col("condition"))), "__flag": F.col("value.flag"), **{f"__stated_{d}": F.col("condition")[d] for d in DIMENSIONS}})
    if bands is not None:
        ready = ready.join(bands, [*(k for k in keys if k != "field_name"), "document_id", "field_name"], "left")
    ready = ready.repartition(*keys).withColumn("__same", F.coalesce(F.col("num").cast("string"), F.col("__flag").cast("double").cast("string"), "canon"))
    ready = ready.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*keys, "ord")))
    group = Window.partitionBy(*keys, "condition_text")
    # The last rank is the number of different values, nulls being one of them; no group's values are held at once.
    ranked = ready.withColumn("__rank", F.dense_rank().over(group.orderBy("__same")))
    return ranked.withColumn("distinct_values", (F.max("__rank").over(group) - F.max(F.col("__same").isNull().cast("int")).over(group)).cast("long")).withColumn("stated", F.struct(*[F.col(f"__stated_{d}").alias(d) for d in DIMENSIONS])).drop("__same", "__rank", "__flag", *[f"__stated_{d}" for d in DIMENSIONS])


#: What judging and grading a pair read of each side; a pair carries nothing else but what its caller asks for.
NEEDED = ("ord", "condition", "kind", "num", "canon", "base", "year", "unit", "unit_fold", "family", "scaled", "floor", "source_tier", "source_id", "record", "ieee", "against_cec_list", "distinct_values")
QUEUED = ("value", "source_ref", "confidence", "copies")
#: What judging and grading a pair compute from its sides and their policy, see compared().
JUDGED = ("form", "x", "scaled_x", "known", "any_alternate", "all_alternate", "many")
POLICY = ("rule_no", "plain", "other", "scales", "numeric", "criticality", "least_grade")


def detect(claims: DataFrame, keys: tuple[str, ...] = (*COMPONENT, "field_name"), *, ascii_only: bool = False, bands: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Graded verdicts on all comparable pairs: keys, l, r, conflicts, conflict_class, reason, severity.

    bands (component keys, document_id, field_name, band) gives declared bands that stand on other fields of a document.
    A candidate set is the pair, its condition group all claims of one side's exact condition. carry names more columns
    of claims that l and r should hold (QUEUED for queue()).
    """
    ready = gathered(claims, keys, ascii_only=ascii_only, bands=bands)
    more = [*carry, *(["band"] if bands is not None else [])]
    told_of = [*NEEDED, *[c for c in more if c not in NEEDED]]
    columns = [*told_of, *JUDGED, "stated"]
    # The policy of a field is looked up once a claim; a pair takes it from its left side.
    pairs = comparison_pairs(compared(policy.with_policy(ready)).select(*keys, *columns, *POLICY), keys, condition="stated", flat=True)
    pairs = pairs.withColumnsRenamed({f"l_{c}": c for c in POLICY}).drop(*[f"r_{c}" for c in POLICY])
    l, r = ({c: F.col(f"{side}_{c}") for c in columns} for side in "lr")  # noqa: E741
    one = {"band_l": l["band"], "band_r": r["band"]} if bands is not None else {}
    out = pairs.withColumn("code", judge(l, r, **one))
    out = graded(out.withColumns(told(F.col("code"), l, r)), l, r)
    return out.select(*keys, _side("l", told_of), _side("r", told_of), "conflicts", "conflict_class", "reason", "severity")


def said(s: Column) -> Column:
    """A side's value with its unit and source, as an explanation names it."""
    return F.concat_ws(" ", F.coalesce(s["canon"], F.lit("nothing")), s["unit"], F.concat(F.lit("("), F.coalesce(s["source_id"], F.lit("no source")), F.lit(")")))


def queue(detected: DataFrame, as_of: Column, keys: tuple[str, ...] = (*COMPONENT, "field_name")) -> DataFrame:
    """Conflict queue entries: an id that depends on the content alone, both candidates in order, no resolution yet.

    shared_id is the id again where another entry may have it, else null: an id tells a key and two claims, so it is an
    entry's own where neither claim has a copy (carry copies, or all ids may be shared).
    """
    entry = F.sha2(F.to_json(F.struct(*keys, "l.ord", F.col("r.ord").alias("r_ord"))), 256)
    own = (F.col("l.copies") == 1) & (F.col("r.copies") == 1) if "copies" in detected.schema["l"].dataType.names else F.lit(False)
    one = lambda s: F.struct(s["value"].alias("value"), s["unit"].alias("unit"), s["source_tier"].alias("source_tier"), s["source_ref"].alias("source_ref"), s["confidence"].alias("confidence"))
    return detected.where("conflicts").select(entry.alias("entry_id"), *keys, "conflict_class", "severity", F.array(one(F.col("l")), one(F.col("r"))).alias("candidates"), F.concat(F.col("reason"), F.lit(": "), said(F.col("l")), F.lit(" against "), said(F.col("r"))).alias("explanation"), as_of.alias("detected_at"), F.lit(None).cast("struct<action:string,resolved_by:string,resolved_at:timestamp,rationale:string,value_before:string,value_after:string>").alias("resolution"), F.when(~own, entry).alias("shared_id"))


def n_different() -> Column:
    """How many different entry_id there are, as an aggregate of entries; only ids that may be shared are shuffled and compared."""
    return F.count(F.lit(1)) - F.count("shared_id") + F.count_distinct("shared_id")


def blocking(conflicts: DataFrame, threshold: int) -> DataFrame:
    """Conflicts without a resolution that are graver than the threshold. Any resolution, a deferral too, unblocks."""
    return conflicts.where(F.col("resolution").isNull() & (F.col("severity") > threshold))


def gate_blocks(conflicts: DataFrame, threshold: int) -> DataFrame:
    """One row: blocks, whether any conflict holds the release back, and how many do."""
    return gates(conflicts, (threshold,)).drop("threshold")


def gates(conflicts: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """gate_blocks() of several thresholds, a row each, in one pass over the conflicts."""
    blocking = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("resolution").isNull() & (F.col("severity") > t)).alias("n_blocking")) for t in thresholds]
    return conflicts.agg(F.array(*blocking).alias("g")).select(F.inline("g")).withColumn("blocks", F.col("n_blocking") > 0)


def manifest(conflicts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every unresolved conflict, the gravest first; carry names more columns of the entries to keep."""
    return conflicts.where("resolution is null").select("entry_id", "field_name", "severity", F.lit("open").alias("status"), *carry).orderBy(F.desc("severity"), "field_name", "entry_id")


def ageing(conflicts: DataFrame, as_of: Column) -> DataFrame:
    """Seconds that each unresolved conflict has waited at as_of."""
    return conflicts.where("resolution is null").withColumn("age_seconds", as_of.cast("timestamp").cast("long") - F.col("detected_at").cast("long"))


def with_ordinals(conflict_candidates: DataFrame) -> DataFrame:
    """Number the candidates of an entry from 0 in their order."""
    return conflict_candidates.withColumn("ordinal", F.row_number().over(Window.partitionBy("entry_id").orderBy("ord")) - 1)


def rebuild_candidates(junction: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates of each entry in ordinal order, from (entry_id, claim_id, ordinal) and claims."""
    rest = [c for c in claims.columns if c != "claim_id"]
    return junction.join(claims, "claim_id").groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "claim_id", *rest))).alias("candidates"))
