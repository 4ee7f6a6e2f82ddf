"""Hash-linked audit streams: appending, verifying, and the tip of each stream."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions import canonical
from concordia.plans.schema import EVENT


def canonical_json(x: object) -> str:
    """RFC 8785: keys by UTF-16 code units, numbers as ECMAScript writes them, no spaces, non-ASCII as is."""
    return canonical.encode(x)


_encode = canonical.encode


def preimage(stream: str, seq: int, kind: str | None, actor: str | None, at: str | None, prev: str | None, payload: str | None) -> str:
    """The canonical JSON of an event, its keys in order; payload is a JSON text."""
    body = _encode(json.loads(payload)) if payload else "null"
    return f'{{"actor":{_encode(actor)},"event_type":{_encode(kind)},"payload":{body},"prev_hash":{_encode(prev)},"recorded_at":{_encode(at)},"seq":{seq},"stream":{_encode(stream)},"v":1}}'


def chain(events: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Give events (stream, document_id, event_type, actor, payload_canonical, recorded_at) their seq, prev_hash and hash.

    A hash is SHA-256 over the canonical JSON of version, stream, seq, type, actor, time, previous hash and payload. A
    stream is a sequential fold, in the order of (recorded_at, event_type, payload): batches of it are streamed and only
    the last hash is carried, so a stream of any length takes constant memory; streams run in parallel. start (stream,
    seq, hash) holds the tips of stored streams that are continued.
    """
    e = events.select("stream", "document_id", "event_type", "actor", "payload_canonical", "recorded_at")
    tips = start.select("stream", F.col("seq").alias("tip_seq"), F.col("hash").alias("tip_hash")) if start is not None else e.sparkSession.createDataFrame([], "stream string, tip_seq long, tip_hash string")
    rows = e.join(tips, "stream", "left").withColumn("at", F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))

    def run(batches):
        stream, seq, prev = None, 0, None
        quoted: dict[str | None, str] = {}  # actors and types are few

        def quote(x: str | None) -> str:
            if x not in quoted:
                if len(quoted) >= 10_000:
                    quoted.clear()
                quoted[x] = _encode(None if pd.isna(x) else x)
            return quoted[x]

        for pdf in batches:
            seqs, prevs, hashes = [], [], []
            for name, kind, actor, payload, at, tip_seq, tip_hash in zip(*(pdf[c].tolist() for c in ("stream", "event_type", "actor", "payload_canonical", "at", "tip_seq", "tip_hash")), strict=True):
                if name != stream:
                    fresh = pd.isna(tip_seq)
                    stream, seq, prev = name, (0 if fresh else int(tip_seq) + 1), (None if fresh else tip_hash)
                    own = _encode(stream)
                body = _encode(json.loads(payload)) if payload else "null"
                link = "null" if prev is None else f'"{prev}"'
                # preimage() with what is the same for many events encoded once.
                text = f'{{"actor":{quote(actor)},"event_type":{quote(kind)},"payload":{body},"prev_hash":{link},"recorded_at":{quote(None) if at is None else f'"{at}"'},"seq":{seq},"stream":{own},"v":1}}'
                digest = hashlib.sha256(text.encode()).hexdigest()
                seqs.append(seq)
                prevs.append(prev)
                hashes.append(digest)
                seq, prev = seq + 1, digest
            yield pdf[["stream", "document_id"]].assign(seq=seqs, prev_hash=prevs, hash=hashes, event_type=pdf["event_type"], actor=pdf["actor"], payload_canonical=pdf["payload_canonical"], recorded_at=pdf["recorded_at"])

    return rows.repartition("stream").sortWithinPartitions("stream", "recorded_at", "event_type", "payload_canonical").mapInPandas(run, EVENT)


def simple_chain(events: DataFrame, stream: str, order: str, text: str) -> DataFrame:
    """seq, prev_hash and hash where a hash covers the event's own text and position alone; built by windows, in SQL.

    The link of an event is the digest of the event before it, so a changed or missing event breaks the link after it.
    """
    w = Window.partitionBy(stream).orderBy(order)
    seq = (F.row_number().over(w) - 1).alias("seq")
    e = events.select(stream, order, seq, F.col(text).alias("payload"))
    e = e.withColumn("hash", F.sha2(F.concat_ws("|", F.col(stream).cast("string"), F.col("seq").cast("string"), "payload"), 256))
    return e.withColumn("prev_hash", F.lag("hash").over(w))


def tips(events: DataFrame) -> DataFrame:
    """The last event of each stream."""
    return events.groupBy("stream").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def broken_links(events: DataFrame) -> DataFrame:
    """Events that break their chain, with the reason: a genesis out of place, a gap, or a parent that isn't the event before."""
    w = Window.partitionBy("stream").orderBy("seq", "hash")
    before, last = F.lag("hash").over(w), F.lag("seq").over(w)
    reason = F.when((F.col("seq") == 0) != F.col("prev_hash").isNull(), "genesis").when(last.isNull() & (F.col("seq") != 0), "missing_start").when(last == F.col("seq"), "duplicate_seq").when(F.col("seq") != last + 1, "gap").when(~F.col("prev_hash").eqNullSafe(before), "parent")
    return events.withColumn("reason", reason).where("reason is not null")


def forks(events: DataFrame) -> DataFrame:
    """(stream, prev_hash) with more than one event, nulls equal, and hashes that occur twice."""
    two = events.groupBy("stream", "prev_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("stream", F.col("prev_hash").alias("hash"), "n", F.lit("fork").alias("reason"))
    return two.unionByName(events.groupBy("stream", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("reason", F.lit("duplicate_hash")))


def recomputed(events: DataFrame) -> DataFrame:
    """Events whose stored hash isn't that of their content; any tampering shows here or as a broken link."""

    @F.pandas_udf("string")
    def digest(stream: pd.Series, seq: pd.Series, kind: pd.Series, actor: pd.Series, at: pd.Series, prev: pd.Series, payload: pd.Series) -> pd.Series:
        none = lambda x: None if pd.isna(x) else x
        return pd.Series([hashlib.sha256(preimage(s, int(q), k, none(a), none(t), none(p), none(x)).encode()).hexdigest() for s, q, k, a, t, p, x in zip(stream, seq, kind, actor, at, prev, payload, strict=True)])

    at = F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return events.where(~digest("stream", "seq", "event_type", "actor", at, "prev_hash", "payload_canonical").eqNullSafe(F.col("hash")))
