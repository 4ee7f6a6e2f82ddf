"""Sources: files by content, tables with header offsets, a Python data source for delimited sheets, and idempotent ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from concordia.operators import documents


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their signature and content hash; nothing depends on names."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("source_uri"), "content", documents.content_signature(F.col("content")).alias("signature"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("data_vintage"))


def parse(raw: DataFrame, parsers: dict[str, Callable], schema: str = "kind string, text string, page int") -> DataFrame:
    """Elements of each file by the parser of its signature (bytes to (kind, text, page) rows); adapters are injected.

    A file without a parser, or whose parser raises, gives one row of kind parse_failed with the error's text.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    if r.signature not in parsers:
                        raise ValueError(f"no parser for {r.signature}")
                    out += [(r.content_hash, *x) for x in parsers[r.signature](bytes(r.content))]
                except Exception as e:  # noqa: BLE001  the row says what happened
                    out.append((r.content_hash, "parse_failed", str(e), None))
            yield pd.DataFrame(out, columns=["content_hash", "kind", "text", "page"])

    return raw.select("content_hash", "signature", "content").mapInPandas(run, f"content_hash string, {schema}")


def ingest(raw: DataFrame, existing: DataFrame, parsers: dict[str, Callable]) -> tuple[DataFrame, DataFrame]:
    """(new documents with their type, their elements); content that is stored already gives neither."""
    new = documents.new_documents(raw, existing, "source_uri")
    elements = parse(new, parsers)
    text = elements.groupBy("content_hash").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "text"))).getField("text"), " ").alias("t"))
    docs = new.join(text, "content_hash", "left").withColumn("document_type", documents.classify(F.coalesce("t", F.lit("")))).drop("t", "content")
    return docs, elements


def routed(docs: DataFrame, elements: DataFrame, *, least_chars: int = 200) -> DataFrame:
    """docs with pages, thin_pages and route: what is to be done with each document next.

    ``failed`` where a parser raised or was missing, ``ocr`` where more than half of the pages have fewer than
    least_chars characters of text, ``review`` where the evidence tells no type, else ``index``. Pages are counted from
    elements; a document without any has route failed.
    """
    size = F.coalesce(F.sum(F.length("text")), F.lit(0))
    pages = elements.where("kind <> 'parse_failed'").groupBy("content_hash", "page").agg(size.alias("chars"))
    read = pages.groupBy("content_hash").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("chars") < least_chars).alias("thin_pages"))
    broken = elements.where("kind = 'parse_failed'").select("content_hash", F.lit(True).alias("__failed")).distinct()
    out = docs.join(read, "content_hash", "left").join(broken, "content_hash", "left")
    route = F.when(F.col("__failed").isNotNull() | F.col("pages").isNull(), "failed").when(2 * F.col("thin_pages") > F.col("pages"), "ocr").when(F.col("document_type").isNull(), "review").otherwise("index")
    return out.withColumn("route", route).drop("__failed")


class _Sheet(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _SheetReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.header, self.sep = int(options.get("headerrow", 1)), options.get("sep", ",")
        self.paths = options["path"].split(",")

    def partitions(self):
        return [_Sheet(p) for p in self.paths]

    def read(self, partition):
        import csv
        import io

        import pyarrow.fs

        fs, path = pyarrow.fs.FileSystem.from_uri(partition.path)
        # Rows are read from the stream as they are needed, and a quoted cell keeps its line ends.
        with fs.open_input_stream(path) as f, io.TextIOWrapper(f, "utf-8-sig", newline="") as text:
            lines = csv.reader(text, delimiter=self.sep)
            for _ in range(self.header - 1):
                next(lines, None)
            head = next(lines, [])
            at = [head.index(n) if n in head else None for n in self.names]
            for row in lines:
                yield tuple(row[i] if i is not None and i < len(row) and row[i] != "" else None for i in at)


class SheetSource(DataSource):
    """Delimited sheets whose header stands in a given row (option headerrow, from 1); columns by name, all strings.

    Used by ``spark.dataSource.register(SheetSource)`` and ``spark.read.format("sheet").schema(...).option(...)``.
    """

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        raise ValueError("give the columns by schema()")

    def reader(self, schema):
        return _SheetReader(schema, self.options)
