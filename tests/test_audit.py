"""RFC 8785 against its published vectors, an independent digest, and chains by streams."""

import hashlib
import json
import random
import struct

import pytest
from concordia.functions import canonical
from concordia.operators import audit
from concordia.sources.folders import checkpoint_folder
from concordia.streaming import streams
from pyspark.sql import functions as F

# The RFC's samples of doubles (as bits) and their texts.
NUMBERS = """0000000000000000 0|8000000000000000 0|0000000000000001 5e-324|8000000000000001 -5e-324|7fefffffffffffff 1.7976931348623157e+308|ffefffffffffffff -1.7976931348623157e+308
|4340000000000000 9007199254740992|c340000000000000 -9007199254740992|4430000000000000 295147905179352830000|44b52d02c7e14af5 9.999999999999997e+22|44b52d02c7e14af6 1e+23|44b52d02c7e14af7 1.0000000000000001e+23
|444b1ae4d6e2ef4e 999999999999999700000|444b1ae4d6e2ef4f 999999999999999900000|444b1ae4d6e2ef50 1e+21|3eb0c6f7a0b5ed8c 9.999999999999997e-7|3eb0c6f7a0b5ed8d 0.000001|41b3de4355555553 333333333.3333332
|41b3de4355555554 333333333.33333325|41b3de4355555555 333333333.3333333|41b3de4355555556 333333333.3333334|41b3de4355555557 333333333.33333343|becbf647612f3696 -0.0000033333333333333333|43143ff3c1cb0959 1424953923781206.2""".replace("\n", "").split("|")


def test_numbers():
    for sample in NUMBERS:
        bits, text = sample.split()
        assert canonical.number(struct.unpack(">d", bytes.fromhex(bits))[0]) == text
    assert [canonical.number(x) for x in (1, -7, 10.0, 1e-7, 2**53, 2**60, 123456789.5)] == ["1", "-7", "10", "1e-7", "9007199254740992", "1152921504606847000", "123456789.5"]
    for bad in (float("nan"), float("inf"), 2**53 + 1, 10**400):
        with pytest.raises(ValueError):
            canonical.number(bad)


def test_documents():
    given = r'''{"numbers":[333333333.33333329,1E30,4.50,2e-3,0.000000000000000000000000001],"string":"\u20ac$\u000F\u000aA'\u0042\u0022\u005c\\\"\/","literals":[null,true,false]}'''
    assert canonical.encode(json.loads(given)) == r'''{"literals":[null,true,false],"numbers":[333333333.3333333,1e+30,4.5,0.002,1e-27],"string":"€$\u000f\nA'B\"\\\\\"/"}'''
    keys = {"€": 1, "\r": 2, "דּ": 3, "1": 4, "\U0001f600": 5, "\x80": 6, "ö": 7}
    assert list(json.loads(canonical.encode(keys)).values()) == [2, 4, 6, 7, 1, 5, 3]  # by UTF-16 units
    with pytest.raises(ValueError):
        canonical.encode("\ud800")
    with pytest.raises(TypeError):
        canonical.encode({1, 2})


EVENTS = "stream string, document_id string, event_type string, actor string, payload_canonical string, recorded_at timestamp"


def audit_events(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["doc:1", "doc:2", "run:a"]), None, rng.choice(["seen", "ok"]), rng.choice(["ann", None]), rng.choice([None, '{"b":1.0,"a":[1e-7,"é"]}', json.dumps({"n": k})]), f"2024-01-{1 + rng.randrange(9):02d} 00:00:{rng.randrange(60):02d}") for k in range(n)]
    return spark.createDataFrame(rows, EVENTS.replace("timestamp", "string")).withColumn("recorded_at", F.to_timestamp("recorded_at"))


def test_hashes_are_those_of_an_independent_encoder(spark):
    rows = audit.chain(audit_events(spark, 60, 1)).orderBy("stream", "seq").collect()
    fixed = {'{"b":1.0,"a":[1e-7,"é"]}': '{"a":[1e-7,"é"],"b":1}'}
    prev = {}
    for r in rows:
        payload = r["payload_canonical"]
        body = "null" if payload is None else fixed.get(payload) or payload.replace(" ", "")
        link = f'"{prev[r["stream"]]}"' if r["seq"] else "null"
        actor = "null" if r["actor"] is None else f'"{r["actor"]}"'
        at = r["recorded_at"].strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        text = f'{{"actor":{actor},"event_type":"{r["event_type"]}","payload":{body},"prev_hash":{link},"recorded_at":"{at}","seq":{r["seq"]},"stream":"{r["stream"]}","v":1}}'
        assert r["hash"] == hashlib.sha256(text.encode()).hexdigest()
        prev[r["stream"]] = r["hash"]


def test_streamed_chains_never_fork(spark):
    """Events arrive shuffled, some late, a batch is run again: one chain a stream that verifies, every event in it once."""
    folder, every = checkpoint_folder(spark), audit_events(spark, 90, 2)
    parts = every.randomSplit([1.0, 1.0, 1.0], seed=4)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/events")
        arrived = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
        streams.append_batches(streams.chained(arrived), f"{folder}/chain", f"{folder}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{folder}/chain")
    assert stored.select("batch").distinct().count() > 3
    # The last batch's commit is lost, and it is run again from the same tips.
    before = sorted(map(tuple, stored.select("stream", "seq", "hash").collect()))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    fs.delete(last, False)
    arrived = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
    streams.append_batches(streams.chained(arrived), f"{folder}/chain", f"{folder}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{folder}/chain").drop("batch")
    assert sorted(map(tuple, stored.select("stream", "seq", "hash").collect())) == before
    assert stored.count() == every.count() == 90
    assert audit.broken_links(stored).isEmpty() and audit.forks(stored).isEmpty() and audit.recomputed(stored).isEmpty()
    columns = ["stream", "event_type", "actor", "payload_canonical", "recorded_at"]
    assert stored.select(columns).exceptAll(every.select(columns)).isEmpty()
