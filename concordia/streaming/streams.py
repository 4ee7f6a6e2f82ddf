"""Structured Streaming: windowed counts with late data, incremental deduplication, append-only sinks, and lease timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

STATE = "status string, lease_owner string, expires long"


def stream(spark: SparkSession, path: str, schema, ts: str = "ts", **options) -> DataFrame:
    """A Parquet folder as a stream whose event time is a timestamp, as watermarks need."""
    return spark.readStream.schema(schema).options(**options).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(df: DataFrame, width: str = "1 hour", *, slide: str | None = None, ts: str = "ts", by: tuple[str, ...] = ("event_type",), late: str = "10 minutes") -> DataFrame:
    """Count and sum by window and key, batch or stream; slide makes windows overlap."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    df = df.withWatermark(ts, late) if df.isStreaming else df
    return df.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", *, ts: str = "ts", by: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap: start, end, count."""
    df = df.withWatermark(ts, late) if df.isStreaming else df
    return df.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(df: DataFrame, key: str, *, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key; a stream forgets keys after late, which bounds its state."""
    if df.isStreaming:
        return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


def append_new(df: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key the table at path doesn't hold; each batch is written once under its own number.

    A batch that is retried overwrites its own partition, so a lost executor or driver adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        new = batch.dropDuplicates([key])
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            new = new.join(spark.read.parquet(path).where(F.col("batch") != number).select(key), key, "left_anti")
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leases(events: DataFrame, lease_seconds: int = 900, *, late: str = "0 seconds") -> DataFrame:
    """Job status from events (job_id, action, owner, ts): claim leases a job, finish ends it, a lease that runs out frees it.

    Each job's state is its status, owner and deadline; the deadline is an event-time timer. Emits a row for each change.
    """

    def step(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        out = []
        status, owner, expires = state.get if state.exists else ("pending", None, 0)
        if state.hasTimedOut:
            if status == "running":
                out.append((key[0], "pending", None, pd.Timestamp(expires, unit="ms"), "expired"))
                status, owner, expires = "pending", None, 0
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "action"])
            for r in rows.itertuples(index=False):
                now = int(r.ts.timestamp() * 1000)
                if status == "running" and expires <= now:
                    out.append((key[0], "pending", None, pd.Timestamp(expires, unit="ms"), "expired"))
                    status, owner, expires = "pending", None, 0
                if r.action == "claim" and status == "pending":
                    status, owner, expires = "running", r.owner, now + lease_seconds * 1000
                elif r.action == "finish" and status == "running" and r.owner == owner:
                    status, owner, expires = "succeeded", None, 0
                else:
                    out.append((key[0], status, owner, r.ts, "refused"))
                    continue
                out.append((key[0], status, owner, r.ts, r.action))
        state.update((status, owner, expires))
        if status == "running":
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "status", "owner", "at", "cause"])

    rows = events.select("job_id", "action", "owner", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, owner string, at timestamp, cause string", STATE, "append", "EventTimeTimeout")


CHAINED = "stream string, document_id string, seq long, prev_hash string, hash string, event_type string, actor string, payload_canonical string, recorded_at timestamp"


def chained(events: DataFrame) -> DataFrame:
    """Audit events (the columns that audit.chain() takes) as they arrive, linked to the tip of their stream.

    A stream's state is its tip alone: the last number and hash, which only the task that holds the stream's state
    continues, so that writers whose events come in any order and at once never fork a chain. Events of one micro-batch
    are taken in the order of (recorded_at, event_type, payload), later batches follow; a late event is linked where it
    arrives. A micro-batch that is run again starts from the same tips and gives the same hashes. The events of one
    stream in one micro-batch are sorted together; maxFilesPerTrigger bounds them.
    """

    def step(key, batches: Iterator, state) -> Iterator:
        import hashlib

        import pandas as pd

        from concordia.operators.audit import preimage

        seq, prev = state.get if state.exists else (-1, None)
        rows = pd.concat(list(batches)).sort_values(["recorded_at", "event_type", "payload_canonical"], kind="stable")
        seqs, prevs, hashes = [], [], []
        none = lambda x: None if pd.isna(x) else x
        for kind, actor, payload, at in zip(rows["event_type"], rows["actor"], rows["payload_canonical"], rows["at"], strict=True):
            seq += 1
            text = preimage(key[0], seq, none(kind), none(actor), none(at), prev, none(payload))
            seqs.append(seq)
            prevs.append(prev)
            prev = hashlib.sha256(text.encode()).hexdigest()
            hashes.append(prev)
        state.update((seq, prev))
        yield pd.DataFrame({"stream": key[0], "document_id": rows["document_id"], "seq": seqs, "prev_hash": prevs, "hash": hashes, "event_type": rows["event_type"], "actor": rows["actor"], "payload_canonical": rows["payload_canonical"], "recorded_at": rows["recorded_at"]})

    at = F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at")
    rows = events.select("stream", "document_id", "event_type", "actor", "payload_canonical", "recorded_at", at)
    return rows.groupBy("stream").applyInPandasWithState(step, CHAINED, "seq long, hash string", "append", "NoTimeout")


def append_batches(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch under its own number, so that one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it gave, for tests and backfills."""
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
