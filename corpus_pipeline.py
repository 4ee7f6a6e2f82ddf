"""The corpus pipeline: toxicity, quality rules, near-duplicates, mixing, packing; each stage reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, in
their order; other columns of docs are left out. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import common, mixing, packing, quality, simhash, toxicity
from concordia.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic; learns from labelled rows outside the held-out fold.

    Labels of one kind, or none, reject nothing; neither is a null, empty or unknown text rejected. Repeated rows and
    rows without an id share the fate of their text. Texts of any length are read whole.
    """
    common.small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands.

    A null or empty text has fewer than ten words and goes, whatever its id; repeated rows share one fate.
    """
    common.small_batches(spark)
    return quality.keep_good(docs.select(*COLUMNS))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard 0.8 or more): that of the least doc_id.

    Of repeated rows with that id one stays. Rows without an id stay; null and empty texts are copies of each other.
    """
    common.small_batches(spark)
    return simhash.deduplicated(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixing schedule, which the written files keep.

    A null source is a source; rows with a null id or text, and repeated rows, keep a place each.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), alpha=0.5)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place; ids are packed little-endian unsigned 32-bit integers.

    docs is read from the files of the stage before, whose order decides which items of one length go first and how
    sequences are numbered. A null text is one end token; repeated rows and rows without an id are packed like others,
    and items of equal length and place are told apart by doc_id, piece and start.
    """
    common.small_batches(spark)
    ordered = packing.file_order(docs.select(*COLUMNS), "position")
    pieces = packing.token_pieces(ordered, tokenizer(), capacity=1024, end_id=2, position="position")
    slim = common.materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(slim, capacity=1024, position="position").drop("position")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_junk),
    ("simhash_dedup", drop_copies),
    ("pfair_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Scores of a trained model, zstandard ratios and a BPE tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, path = docs, common.fresh_path(spark, f"stage-{name}")
        with common.scratch():  # a stage's own tables go once its result is written
            out = stage(spark, docs, sf_dir)
            schema = out.schema
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        docs._concordia_path = path
        common.discard(before)
    return docs
