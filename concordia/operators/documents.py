"""Documents and chunks: content signatures, idempotent ingest, chunking, units, parse audits."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from concordia.plans import policy

# Leading bytes (hex) of formats; Office files are told apart by names inside the archive.
SIGNATURES = [("25504446", "pdf"), ("FFD8FF", "jpg"), ("89504E470D0A1A0A", "png"), ("49492A00", "tif"), ("4D4D002A", "tif"), ("424D", "bmp")]
#: What speaks for a document type, and how much. A type is told by the sum of weight * log(1 + occurrences) over its words.
EVIDENCE = [
    ("warranty", "warranty", 2.0), ("warranted", "warranty", 1.0), ("purchase order", "purchase_order", 3.0), ("ship to", "purchase_order", 1.0), ("terms and conditions", "terms_and_conditions", 3.0),
    ("terms of service", "contract_tos", 3.0), ("agreement", "contract_tos", 1.5), ("contract", "contract_tos", 1.0), ("hereinafter", "contract_tos", 1.5), ("regulation", "environmental_regulation", 1.5), ("emission", "environmental_regulation", 1.0),
    ("price", "pricing", 1.0), ("quotation", "pricing", 2.5), ("datasheet", "spec_sheet", 3.0), ("data sheet", "spec_sheet", 3.0), ("nominal", "spec_sheet", 1.0), ("certificate", "technical_documentation", 2.0), ("test report", "technical_documentation", 3.0), ("manual", "technical_documentation", 1.5),
]
#: The least score that decides, and by how much the best type must lead the second.
DECIDED, LEAD = 1.0, 0.5
#: Units as they are printed of peak and alternating power, for the family that they are compared in.
PRINTED_UNITS = {"wp": "w", "kwp": "kw", "mwp": "mw", "wac": "w", "kwac": "kw", "mwac": "mw"}
UNIT_ALIASES = {"%/°c": "%/k", "%/degc": "%/k", "%/k": "%/k", "wp": "wp", "watt": "w", "watts": "w", "volt": "v", "volts": "v", "amp": "a", "amps": "a"}


def looks_delimited(text: Column) -> Column:
    """Whether text is no markup and half of its lines, two at least, have commas, semicolons or tabs outside of quotes, all as many."""
    bare = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), "\r\n?", "\n")
    lines = F.filter(F.split(bare, "\n"), lambda x: F.trim(x) != "")
    even = F.lit(False)
    for d in (",", ";", "\t"):
        counts = F.filter(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))), lambda n: n > 0)  # noqa: B023  called at once
        even = even | ((F.size(F.array_distinct(counts)) == 1) & (F.size(counts) > 1) & (2 * F.size(counts) >= F.size(lines)))
    return F.coalesce(even & ~F.startswith(F.ltrim(text), F.lit("<")), F.lit(False))


def content_signature(content: Column) -> Column:
    """Format by magic bytes, never by name: pdf docx xlsx jpg png tif bmp webp heic csv, else unknown."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for magic, name in reversed(SIGNATURES):
        out = F.when(F.startswith(head, F.lit(magic)), name).otherwise(out)
    has = lambda s: F.contains(content, F.lit(s.encode()))
    zipped = F.startswith(head, F.lit("504B0304"))
    kind = _archive_kind(F.when(zipped, content))  # other contents aren't sent to Python
    printable = ~has("\0") & (F.octet_length(content) > 0)
    return (
        F.when(zipped, kind)
        .when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(F.substring(head, 9, 8) == "66747970", F.when(F.substring(head, 17, 8).isin("68656963", "68656978", "68657663", "68657678", "6D696631"), "heic"))
        .when(out.isNotNull(), out)
        .when(F.coalesce(printable, F.lit(False)) & looks_delimited(F.try_validate_utf8(content.cast("string"))), "csv")
        .otherwise("unknown")
    )


def type_scores(text: Column) -> Column:
    """array<struct<score, type>> of the document types, the best first; ties by name."""
    low, by = F.lower(text), {}
    for word, name, weight in EVIDENCE:
        n = (F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)
        by[name] = by.get(name, F.lit(0.0)) + weight * F.log1p(n)
    return F.reverse(F.array_sort(F.array(*[F.struct(F.round(s, 9).alias("score"), F.lit(name).alias("type")) for name, s in by.items()])))


def classify(text: Column) -> Column:
    """The document type that the evidence of all words tells, null where it is weak or two types are close: that is for a person to say."""
    return F.transform(F.array(type_scores(text)), lambda s: F.when((s[0]["score"] >= DECIDED) & (s[0]["score"] - s[1]["score"] >= LEAD), s[0]["type"]))[0]


@F.pandas_udf(StringType())
def _archive_kind(content: pd.Series) -> pd.Series:
    """What a ZIP archive is by the member names in its directory, not by bytes that stand anywhere: docx, xlsx or zip."""

    def kind(raw) -> str | None:
        if raw is None:
            return None
        try:
            names = zipfile.ZipFile(io.BytesIO(raw)).namelist()
        except (zipfile.BadZipFile, ValueError):
            return "zip"
        return "docx" if "word/document.xml" in names else "xlsx" if "xl/workbook.xml" in names else "zip"

    return content.map(kind, na_action="ignore")


def normalize_unit(raw: Column) -> Column:
    """struct(value, unit, verbatim) of a printed quantity; a decimal comma is read as a point, %/°C is %/K unconverted."""
    n = F.regexp_extract(raw, r"^\s*([+-]?[0-9][0-9.,]*(?:[eE][+-]?[0-9]+)?)", 1)
    thousands = F.regexp_replace(n, r",(?=\d{3}(\D|$))", "")
    point = F.when(F.regexp_like(n, F.lit(r"^[+-]?\d+,\d{1,2}$|^[+-]?\d{1,3}(\.\d{3})+,\d+$")), F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(thousands)
    unit = F.lower(F.trim(F.regexp_replace(raw, r"^\s*[+-]?[0-9][0-9.,]*(?:[eE][+-]?[0-9]+)?", "")))
    table = F.create_map(*[F.lit(x) for kv in UNIT_ALIASES.items() for x in kv])
    return F.struct(point.try_cast("double").alias("value"), F.nullif(F.coalesce(F.try_element_at(table, unit), unit), F.lit("")).alias("unit"), raw.alias("verbatim"))


def canonical_quantity(raw: Column) -> Column:
    """struct(value, unit, family, base) of a printed quantity: base is the value in its family's base unit, null for an unknown unit."""

    def of(n: Column) -> Column:
        unit = policy.unit_base(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRINTED_UNITS.items() for x in kv]), n["unit"]), n["unit"]))
        return F.struct(n["value"].alias("value"), n["unit"].alias("unit"), unit["family"].alias("family"), (n["value"] * unit["factor"]).alias("base"))

    return F.transform(F.array(normalize_unit(raw)), of)[0]


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def new_documents(incoming: DataFrame, existing: DataFrame, order: str, key: str = "content_hash") -> DataFrame:
    """Incoming rows whose content is not stored yet, the first by order of each; running it twice adds nothing."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*[c for c in incoming.columns if c != key]), order).alias("d")).select(key, "d.*")
    return first.join(existing.select(key).distinct(), key, "left_anti").select(*incoming.columns)


def refuse_duplicates(claims: DataFrame, key: list[str]) -> DataFrame:
    """Natural keys that occur more than once."""
    return claims.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upserted(log: DataFrame, key: str, version: str, deleted: str) -> DataFrame:
    """The state of a log of upserts and deletions: each key's latest row, unless that is a deletion. One aggregation."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(key, "r.*").where(~F.col(deleted))


def chunks(documents: DataFrame, *, id_col: str = "document_id", text_col: str = "text", size: int = 512, overlap: float = 0.05) -> DataFrame:
    """Windows of size words that overlap by a share: id, chunk_no, start, n_words, chunk_text. Row-local, no shuffle.

    The step is size less the overlap, rounded down to at least 1; a text without words has no chunk.
    """
    step = max(1, size - int(size * overlap))
    words = F.filter(F.split(F.col(text_col), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    d = documents.select(F.col(id_col), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / step), F.lit(0)).cast("int")
    return d.select(id_col, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")).select(
        id_col, "chunk_no", (F.col("chunk_no") * step).alias("start"), F.least(F.lit(size), F.size("w") - F.col("chunk_no") * step).alias("n_words"), F.array_join(F.slice("w", F.col("chunk_no") * step + 1, F.lit(size)), " ").alias("chunk_text")
    )


def structured_chunks(elements: DataFrame, *, size: int = 512, overlap: float = 0.05) -> DataFrame:
    """Chunks of elements (document_id, position, section, kind, text), by structure first: document_id, section,
    chunk_kind, chunk_no, n_words, chunk_text.

    Prose is joined within its section, in the order of position, and only then cut by size, so no chunk crosses a
    section. A table is one chunk, whatever its size. A section is gathered in one row, as a document's pages are.
    """
    prose = elements.where("kind <> 'table'").groupBy("document_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("text"))
    cut = chunks(prose.withColumn("id", F.struct("document_id", "section")), id_col="id", size=size, overlap=overlap)
    cut = cut.select("id.document_id", "id.section", F.lit("prose").alias("chunk_kind"), "chunk_no", "n_words", "chunk_text")
    words = F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    tables = elements.where("kind = 'table'").select("document_id", "section", F.lit("table_full").alias("chunk_kind"), F.lit(0).alias("chunk_no"), words.alias("n_words"), F.col("text").alias("chunk_text"))
    return cut.unionByName(tables)


def index_documents(incoming: DataFrame, elements: DataFrame, indexed: DataFrame, embedder, **how) -> DataFrame:
    """Chunks with embeddings of the incoming documents (document_id, content_hash) whose content indexed doesn't hold.

    Running it again after its result is stored adds nothing. embedder is a function of a pandas series of texts.
    """
    new = incoming.join(indexed.select("content_hash").distinct(), "content_hash", "left_anti")
    own = structured_chunks(elements.join(new.select("document_id"), "document_id", "left_semi"), **how)
    return own.withColumn("embedding", F.pandas_udf(embedder, "array<float>")(F.col("chunk_text")))


def table_chunks(cells: DataFrame) -> DataFrame:
    """Three chunks of kinds table_full, table_row and table_summary from cells (document_id, table_id, row_no, header, value).

    Rows carry their headers, so each stands alone; tables are never split.
    """
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("header", "value"))), lambda x: F.concat_ws(": ", x["header"], x["value"])), "; ")
    by_row = cells.groupBy("document_id", "table_id", "row_no").agg(line.alias("chunk_text"))
    full = by_row.groupBy("document_id", "table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "chunk_text"))), lambda x: x["chunk_text"]), "\n").alias("chunk_text"))
    heads = cells.groupBy("document_id", "table_id").agg(F.concat(F.lit("columns: "), F.array_join(F.array_sort(F.collect_set("header")), ", "), F.lit("; rows: "), F.count_distinct("row_no").cast("string")).alias("chunk_text"))
    return full.withColumn("chunk_kind", F.lit("table_full")).unionByName(by_row.drop("row_no").withColumn("chunk_kind", F.lit("table_row"))).unionByName(heads.withColumn("chunk_kind", F.lit("table_summary")))


def parse_audit(parsed: DataFrame) -> DataFrame:
    """parse_status of (n_chars, raw_chars, n_cells, has_table): failed documents are marked and never dropped."""
    bad = (F.col("n_chars") == 0) | (F.col("n_chars") < 0.1 * F.col("raw_chars")) | (F.col("has_table") & (F.col("n_cells") == 0))
    return parsed.withColumn("parse_status", F.when(F.coalesce(bad, F.lit(True)), "parse_failed").otherwise("parsed"))


def fall_back(documents: DataFrame, engines: list) -> DataFrame:
    """Parse with the first engine, those that fail with the next, and so on; what fails everywhere stays, marked."""
    done, rest = None, documents
    for engine in engines:
        audited = parse_audit(engine(rest))
        good = audited.where("parse_status = 'parsed'")
        done = good if done is None else done.unionByName(good)
        failed = audited.where("parse_status = 'parse_failed'")
        rest = failed.select(*documents.columns)
    return done.unionByName(failed)
