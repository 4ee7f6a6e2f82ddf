"""Best-fit packing: documents as token pieces, packed by best-fit decreasing into sequences of fixed capacity.

Items of one length are interchangeable, so best-fit decreasing over all items depends only on the count of each
length: at most ``capacity`` numbers, whatever the input's size. The driver runs it on these counts with a segment
tree over remaining capacities that finds the tightest open bin in logarithmic time; bins of equal history are kept
as runs, so its output is a few thousand placement rules. Rows learn their place from their rank among items of their
length, which is computed without bringing a length to one task.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import materialize, power_of_two, ranked

#: Rows that one slot of a length should hold when ranks are computed.
SLOT_ROWS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: White space other than space, tab, newline and carriage return, and what only some libraries call white space.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: A pre-token never runs from non-space into space, so text may be cut there and the parts encoded alone.
_CHUNK = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")


class CachedEncoder(dict):
    """Text to little-endian unsigned 32-bit ids of a byte-level BPE ``tokenizers`` file.

    Whole texts go through ``tiktoken`` with the file's own vocabulary and pattern, which gives the same ids several
    times faster. Other models, or a vocabulary for which it doesn't, use ``tokenizers``; where a pre-token never runs
    from non-space into space, chunks that begin at a white-space run are then encoded once and kept, at most ``bound``.
    """

    def __init__(self, path: str, bound: int = 300_000):
        import json

        import tokenizers

        self.bound, self.hf = bound, tokenizers.Tokenizer.from_file(path)
        self.hf.encode_special_tokens = True
        self.fast, self.chunked = None, False
        #: The bytes of each id, where ids stand for bytes; with them texts are decoded without the library.
        self.pieces: dict[int, bytes] = {}
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"):
            self.chunked = True
            self._tiktoken(spec)

    def _tiktoken(self, spec: dict) -> None:
        import tiktoken

        #: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
        probe = "It's Ünïcode, 12 345\n\n  and  tabs\t! <|x|> naïve ciónment 漢字 \U0001f600 "
        if fast.encode_ordinary(probe) == self.hf.encode(probe, add_special_tokens=False).ids:
            self.fast = fast
            self.pieces = {i: b for b, i in vocab.items()} | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}

    def _ids(self, text: str) -> bytes:
        ids = array("I", self.fast.encode_ordinary(text) if self.fast else self.hf.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, chunk: str) -> bytes:
        out = self._ids(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.fast or not self.chunked or _ODD_SPACE.search(text):
            return self._ids(text)
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, position: str | None = None) -> DataFrame:
    """Encode every whole text and cut what is longer than capacity: doc_id, piece, start, length, ids (packed LE u32).

    A document is its ids, then end_id. Only longer documents are cut: the first piece takes the remainder, all
    others are full. A null text is empty, and so one end id. Repeated rows give repeated pieces; a null doc_id stays.
    A long column named by position is kept as the last one.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, end = CachedEncoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()][: None if position else 5]
        names = ["doc_id", "piece", "start", "length", "ids", position][: len(types)]

        def flush(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

        rows, held = [], 0
        for batch in batches:
            for i, text, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                at, stop, piece = 0, n % capacity or capacity, 0
                while at < n:
                    rows.append((i, piece, at, stop - at, ids[4 * at : 4 * stop], *place))
                    at, stop, piece = stop, stop + capacity, piece + 1
                    held += 4 * capacity
                if held > 1 << 24:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    kept = [F.col(position).cast("long")] if position else []
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *kept).mapInArrow(run, f"{PIECES}, {position} long" if position else PIECES)


class Tightest:
    """Segment tree over remaining capacities 0..top; find(s) is the least capacity >= s of an open bin, or -1."""

    def __init__(self, top: int):
        self.leaves = power_of_two(top + 1, 1, 1 << 40)
        self.open = [False] * (2 * self.leaves)

    def put(self, capacity: int, is_open: bool) -> None:
        k = capacity + self.leaves
        self.open[k] = is_open
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def find(self, size: int) -> int:
        k = size + self.leaves
        if k >= 2 * self.leaves:
            return -1
        while not self.open[k]:
            while k & 1:  # a right child: go up
                k //= 2
            if k == 0:
                return -1
            k += 1
            if k & (k - 1) == 0:  # past the last node of its level
                return -1
        while k < self.leaves:
            k = 2 * k if self.open[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placement rules (length, first rank, ranks, first bin, items a bin, offset) of best-fit decreasing.

    Item r of a length, counted from the rule's first rank, goes to bin ``first bin + r // items`` at
    ``offset + r % items * length``.
    """
    tree, runs, rules, bins = Tightest(capacity), {}, [], 0

    def add(left: int, first: int, n: int) -> None:
        if left and n:
            runs.setdefault(left, []).append((first, n))
            tree.put(left, True)

    for size in sorted((s for s in counts if counts[s]), reverse=True):
        rank, rest = 0, counts[size]
        while rest:
            left = tree.find(size)
            if left < 0:
                left, n = capacity, -(-rest // (capacity // size))
                first, bins = bins, bins + n
            else:
                first, n = runs[left].pop()
                if not runs[left]:
                    tree.put(left, False)
            # The tightest bin stays the tightest while another item fits, so each bin is filled in turn.
            each = left // size
            full = min(n, rest // each)
            some = rest - full * each if full < n else 0
            rules.append((size, rank, full * each + some, first, each, capacity - left))
            add(left - each * size, first, full)
            if some:
                add(left - some * size, first + full, 1)
            add(left, first + full + bool(some), n - full - bool(some))
            rank, rest = rank + full * each + some, rest - full * each - some
    return rules


def file_order(docs: DataFrame, name: str) -> DataFrame:
    """docs, read from Parquet files, with each row's number (column name) in the order in which the files were written.

    The driver gets one count a file. Rows that don't come from files have no such order: AnalysisException.
    """
    task = lambda f: (int(re.search(r"part-(\d+)", f).group(1)) if re.search(r"part-(\d+)", f) else 0, f)
    placed = docs.select(*docs.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = {r["__file"]: int(r["n"]) for r in placed.groupBy("__file").agg((F.max("__row") + 1).alias("n")).collect()}
    starts, at = [], 0
    for f in sorted(counts, key=lambda f: task(f.rsplit("/", 1)[-1])):
        starts.append((f, at))
        at += counts[f]
    start = docs.sparkSession.createDataFrame(starts, "__of string, __start long")
    return placed.join(F.broadcast(start), F.col("__file") == F.col("__of")).withColumn(name, F.col("__start") + F.col("__row")).drop("__file", "__row", "__of", "__start")


def pack(pieces: DataFrame, *, capacity: int = 1024, position: str | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces (length 1..capacity; other columns stay, pieces must be re-readable).

    Best-fit decreasing over all rows. The driver holds one count a length and a few thousand rules; the join
    broadcasts these rules, whose number depends on capacity and not on the rows. An empty table gives an empty one.
    With the column position (0 or more), items of one length are placed in its order, and sequences are numbered in
    the order of the first position they hold.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    rules = best_fit_decreasing(counts, capacity)
    rule = spark.createDataFrame(rules, "__size long, __rank0 long, __ranks long, __bin0 long, __each long, __off long")
    salt = F.xxhash64("doc_id", "piece", "start")
    slots = power_of_two(max(counts.values(), default=0) / SLOT_ROWS, 16, 1 << 16)
    order = [F.col("doc_id"), F.col("piece"), F.col("start")]
    if position:
        top = (pieces.agg(F.max(position)).first()[0] or 0) + 1
        part = lambda c: F.floor(F.col(c) * F.lit(float(slots / top)))  # noqa: E731  grows with position and stays below slots
        salt, order = part(position), [F.col(position), *order]
    numbered = ranked(pieces, ["length"], order, salt, slots, "__rank")
    r = F.col("__rank") - F.col("__rank0")
    at = (F.col("length") == F.col("__size")) & (r >= 0) & (r < F.col("__ranks"))
    placed = (
        numbered.join(F.broadcast(rule), at)
        .withColumn("sequence_id", F.expr("__bin0 + (__rank - __rank0) div __each"))
        .withColumn("offset", F.expr("__off + (__rank - __rank0) % __each * length"))
        .drop("__rank", "__size", "__rank0", "__ranks", "__bin0", "__each", "__off")
    )
    if not position:
        return placed
    placed = materialize(placed, "placed")
    firsts = placed.groupBy(F.col("sequence_id").alias("__bin")).agg(F.min(position).alias("__first"))
    number = ranked(firsts, [], [F.col("__first"), F.col("__bin")], part("__first"), slots, "__number")
    return placed.join(number, F.col("sequence_id") == F.col("__bin")).withColumn("sequence_id", F.col("__number")).drop("__bin", "__first", "__number").select(*placed.columns)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """token_pieces() written once to the shared folder, then packed: doc_id, piece, start, length, ids, sequence_id, offset."""
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id), "pieces"), capacity=capacity)
