"""The tagged value of a claim, printed precision and vector similarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordia.functions.text import python_repr

_PARTS = {"num": "double", "is_int": "boolean", "txt": "string", "flag": "boolean", "items": "array<string>", "entries": "map<string,string>", "band": "struct<low:double,high:double,kind:string,unit:string>"}


def _value(kind: str, canon: Column, present: Column, **parts: Column) -> Column:
    fields = [parts[k].cast(t).alias(k) if k in parts else F.lit(None).cast(t).alias(k) for k, t in _PARTS.items()]
    return F.when(present, F.struct(F.lit(kind).alias("kind"), *fields, canon.alias("canon")))


def number(x: Column, is_int: bool = False, canon: Column | None = None) -> Column:
    """A numeric value; integers and floats of one size have different canonical texts. Give canon to stay in SQL functions."""
    text = canon if canon is not None else (x.cast("bigint").cast("string") if is_int else python_repr(x.cast("double")))
    return _value("num", text, x.isNotNull(), num=x, is_int=F.lit(is_int))


def text(x: Column) -> Column:
    return _value("text", F.concat(F.lit("'"), x, F.lit("'")), x.isNotNull(), txt=x)


def boolean(x: Column) -> Column:
    return _value("flag", F.initcap(x.cast("string")), x.isNotNull(), flag=x)


def listing(x: Column) -> Column:
    """An ordered list; an empty list is a value, unlike null."""
    return _value("list", F.concat(F.lit("list["), F.array_join(F.transform(x, lambda i: F.concat(F.lit("'"), i, F.lit("'"))), ", "), F.lit("]")), x.isNotNull(), items=x)


def mapping(x: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'")))
    return _value("map", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), x.isNotNull(), entries=x)


def band(low: Column, high: Column, kind: Column, unit: Column) -> Column:
    b = F.struct(low.alias("low"), high.alias("high"), kind.alias("kind"), F.nullif(F.trim(unit), F.lit("")).alias("unit"))
    return _value("band", F.to_json(b), low.isNotNull() & high.isNotNull(), band=b)


def places(t: Column) -> Column:
    """Decimal places of a printed number, its exponent counted."""
    mantissa = F.length(F.regexp_extract(t, r"\.(\d+)", 1))
    # An empty text is no exponent; casting it would throw and catch an exception a row, which costs more than all the rest.
    exponent = F.coalesce(F.nullif(F.regexp_extract(t, r"[eE]([+-]?\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0))
    return F.greatest(F.lit(0), mantissa - exponent)


def _readings(verbatim: Column) -> Column:
    """The numbers that a printed text may hold, as texts: a run of digits, points and commas is read once with its commas
    as ends of numbers, and once without them where each is followed by three digits and no fourth."""
    runs = F.regexp_extract_all(verbatim, F.lit("-?[0-9][0-9,.]*([eE][-+]?[0-9]+)?"), F.lit(0))
    bare = F.transform(runs, lambda run: F.rtrim(run, F.lit(".,")))
    apart = F.flatten(F.transform(bare, lambda run: F.transform(F.split(run, ","), lambda x: F.rtrim(x, F.lit(".")))))
    groups = lambda run: F.slice(F.split(F.substring_index(run, ".", 1), ","), F.lit(2), F.length(run))
    whole = F.filter(bare, lambda run: F.forall(groups(run), lambda g: F.length(F.regexp_extract(g, "^[0-9]+", 0)) == 3))
    return F.array_union(F.transform(whole, lambda run: F.replace(run, F.lit(","), F.lit(""))), apart)


def printed_decimals(verbatim: Column, num: Column, is_int: Column, fallback: Column) -> Column:
    """Decimal places with which a number was printed: the most among the readings of the verbatim text that equal it;
    without such a reading 0 for an integer, else those of the fallback text."""
    same = F.transform(F.filter(_readings(verbatim), lambda t: t.try_cast("double") == num), places)
    return F.coalesce(F.array_max(same), F.when(is_int, F.lit(0)).otherwise(places(fallback)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for a null, zero or unequally long vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * F.lit(tolerance), F.lit(tolerance))
