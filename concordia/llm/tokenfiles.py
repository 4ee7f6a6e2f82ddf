"""Token files: the ids of documents in order, as canonical length-limited Huffman codes.

Code lengths come from the global counts of all ids by package-merge; a file's header holds just these lengths. A file
is a sequence of blocks of whole documents. A block can be read alone: it has its documents' ids and token counts, its
place in the sequence, the bit offset of every 256th token (a checkpoint) and a checksum. Decoders look the next
``limit`` bits up in one table and follow all checkpoints of several blocks at once. The index has a row a block.

Header: ``CHTK``, version, limit (1 byte each), symbols and bytes of the zlib'd lengths (4 bytes each), the lengths.
Block: ``BLCK``, crc32 of what follows, documents (4 bytes each), tokens, first token, payload bytes (8 each); then per
document its id (8), whether it has one (1) and its tokens (8); then the checkpoints (8 each); then the payload, codes
from the highest bit down. Numbers are little-endian.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm.common import fresh_path, materialize
from concordia.llm.packing import CachedEncoder

#: Tokens between checkpoints; tokens at which a block is closed (a longer document makes a longer block); bytes at
#: which a file is closed; bytes that are read and decoded at once.
STEP, BLOCK_TOKENS, FILE_BYTES, RANGE_BYTES = 256, 1 << 16, 128 << 20, 2 << 20
#: Bytes of ids that a task sorts and writes: PART_BYTES, or down to LEAST_BYTES where not all cores would have work.
PART_BYTES, LEAST_BYTES = 256 << 20, 4 << 20
#: Bits of the longest code that a decoder's table takes (2^25 entries); every vocabulary of up to 2^23 ids fits.
LONGEST = 25
HEAD, BLOCK = "<4sBBII", "<4sIIQQQ"
INDEX = "file string, part long, offset long, bytes long, first long, n_tokens long, n_docs long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    """Kept by the worker process for its next tasks."""
    return CachedEncoder(path)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal lengths of at most limit bits by package-merge; 0 for symbols that don't occur, 1 for an only one."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    rising = used[np.argsort(counts[used], kind="stable")]
    weight = counts[rising].astype(np.int64)
    single, merged = [], weight
    single.append(np.ones(len(weight), bool))
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        single.append(order < len(weight))
        merged = both[order]
    take, bits = 2 * len(used) - 2, np.zeros(len(used), np.uint8)
    for flags in reversed(single):  # the cheapest items of a list; its packages are the cheapest pairs of the list before
        alone = int(flags[:take].sum())
        bits[:alone] += 1
        take = 2 * (take - alone)
    lengths[rising] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes that rise with (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for n in np.unique(lengths[order]).tolist():
        same = order[lengths[order] == n]
        code <<= n - last
        codes[same] = code + np.arange(len(same), dtype=np.uint64)
        code, last = code + len(same), n
    return codes


def decoding_table(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For every value of the next limit bits: symbol * 32 + length of its code; -1 where no code begins so."""
    table, codes = np.full(1 << limit, -1, np.int64), canonical(lengths)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    n = lengths[order].astype(np.int64)
    entries = order * 32 + n
    filled = np.repeat(entries, 1 << (limit - n))  # canonical codes fill the table from its start
    assert not len(order) or int(codes[order[0]]) == 0
    table[: len(filled)] = filled
    return table


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids one after the other, from the highest bit down, and the bit at which each begins."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros((total >> 5) + 2, np.uint32)
    if len(ids):
        place, shift = at >> 5, (64 - (at & 31) - n).astype(np.uint64)
        window = codes[ids] << shift
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        own = place[first]
        words[own] |= np.bitwise_or.reduceat((window >> np.uint64(32)).astype(np.uint32), first)
        words[own + 1] |= np.bitwise_or.reduceat(window.astype(np.uint32), first)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], at


def header(lengths: np.ndarray, limit: int) -> bytes:
    packed = zlib.compress(lengths.tobytes(), 9)
    return struct.pack(HEAD, b"CHTK", 1, limit, len(lengths), len(packed)) + packed


def parse_header(raw: bytes) -> tuple[np.ndarray, int]:
    magic, version, limit, symbols, n = struct.unpack_from(HEAD, raw)
    if magic != b"CHTK" or version != 1:
        raise ValueError("not a token file of version 1")
    lengths = np.frombuffer(zlib.decompress(raw[struct.calcsize(HEAD) : struct.calcsize(HEAD) + n]), np.uint8)
    if len(lengths) != symbols:
        raise ValueError("a token file's header is damaged")
    return lengths, limit


def make_block(doc_ids: list, ids: list[np.ndarray], first: int, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    every = np.concatenate(ids)
    payload, at = pack_bits(every, lengths, codes)
    has = np.array([i is not None for i in doc_ids], np.uint8)
    body = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + has.tobytes() + np.array([len(x) for x in ids], "<u8").tobytes() + at[::STEP].astype("<u8").tobytes() + payload
    rest = struct.pack("<IQQQ", len(ids), len(every), first, len(payload)) + body
    return b"BLCK" + struct.pack("<I", zlib.crc32(rest)) + rest


def parse_block(raw: bytes) -> tuple[list, np.ndarray, int, np.ndarray, bytes]:
    """doc_ids, tokens of each document, first token, checkpoints, payload; checks the block's checksum."""
    magic, crc, docs, tokens, first, size = struct.unpack_from(BLOCK, raw)
    if magic != b"BLCK" or zlib.crc32(raw[8:]) != crc:
        raise ValueError("a block of a token file is damaged")
    at = struct.calcsize(BLOCK)
    doc_ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    has = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
    n = -(-tokens // STEP)
    points = np.frombuffer(raw, "<u8", n, at + 17 * docs).astype(np.int64)
    at += 17 * docs + 8 * n
    return [i if h else None for i, h in zip(doc_ids, has.tolist(), strict=True)], counts, first, points, raw[at : at + size]


def decode(payloads: list[bytes], points: list[np.ndarray], counts: list[int], table: np.ndarray, limit: int) -> list[np.ndarray]:
    """The ids of several blocks: every checkpoint is followed for STEP tokens, all of them side by side."""
    bases = np.cumsum([0, *map(len, payloads)])
    raw = np.frombuffer(b"".join(payloads) + bytes(4 * STEP + 8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = np.concatenate([p + 8 * b for p, b in zip(points, bases, strict=False)])
    out = np.empty((STEP, len(at)), np.int64)
    mask, spare = (1 << limit) - 1, 32 - limit
    for k in range(STEP):
        # The last checkpoint of a block has fewer tokens; what it reads past them is cut off below.
        entry = table[window[at >> 3] >> (spare - (at & 7)) & mask]
        out[k] = entry >> 5
        at += entry & 31
    flat, found, lo = out.T.ravel(), [], 0
    for p, n in zip(points, counts, strict=True):
        ids = flat[lo : lo + n]
        if n and ids.min() < 0:
            raise ValueError("a block of a token file is damaged")
        found.append(ids)
        lo += STEP * len(p)
    return found


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[DataFrame, str]:
    """A written table doc_id, n_tokens, ids, tie of all whole texts, with end_id after each, and the type of its ids."""
    vocabulary = max(encoder(tokenizer_path).hf.get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, end = encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(own.encode(text.as_py() or "") + end, "<u4")
                rows.append((i, len(ids), ids.astype(kind).tobytes()))
                held += 4 * len(ids)
                if held > 1 << 24:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    coded = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")
    return materialize(coded.withColumn("tie", F.xxhash64("ids")), "tokens"), kind


def global_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs; counted in tasks first, so that the driver gets a number for each id of the vocabulary."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(0, np.int64)
        for b in batches:
            for ids in b.column(0):
                n = np.bincount(np.frombuffer(ids.as_py(), kind))
                if len(n) > len(counts):
                    counts, n = n.astype(np.int64), counts
                counts[: len(n)] += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_files(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 0) -> DataFrame:
    """Write the ids of every document of docs (doc_id, text) to files in folder, by rising doc_id; returns the block index.

    The index is a table in the shared folder: file, offset, bytes, first (number of the block's first token in the whole
    sequence), n_tokens, n_docs, and part, by which files follow each other. A document is its ids, then end_id. A null
    text is empty; rows without a doc_id come first; rows of equal doc_id are ordered by a hash of their ids, so that
    they can be spread over tasks, and equal rows are interchangeable. Texts of any length are encoded whole; a long one
    is a block by itself. Only doc_id and text are read, so other columns cannot clash; an empty table writes no file.
    Every attempt of a task writes files of its own, so that a retried task leaves only files that no index row names.
    """
    tokens, kind = token_rows(docs, tokenizer_path, end_id)
    counts = global_counts(tokens, kind)
    limit = min(LONGEST, max(12, int(np.count_nonzero(counts)).bit_length() + 2))
    lengths = code_lengths(counts, limit)
    shared = docs.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.fs
        from pyspark import TaskContext

        lengths = shared.value
        codes, head, part = canonical(lengths), header(lengths, limit), TaskContext.get().partitionId()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, first = None, "", 0, 0
        doc_ids, ids, held, rows = [], [], 0, []

        def close_block() -> None:
            nonlocal out, name, at, first, held
            if out is None:
                name, at = f"{uuid.uuid4().hex}.tokens", len(head)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(head)
            block = make_block(doc_ids, ids, first, lengths, codes)
            out.write(block)
            rows.append((name, part, at, len(block), first, held, len(ids)))
            at, first, held = at + len(block), first + held, 0
            doc_ids.clear(), ids.clear()
            if at >= FILE_BYTES:
                out.close()
                out = None

        for b in batches:
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                doc_ids.append(i), ids.append(np.frombuffer(x.as_py(), kind))
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    close_block()
        if ids:
            close_block()
        if out is not None:
            out.close()
        if rows:
            types = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    size, cores = int(counts.sum()) * int(kind[-1]), docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-size // PART_BYTES), min(4 * cores, -(-size // LEAST_BYTES)))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = tokens.select("doc_id", "tie", "ids").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    written = materialize(ordered.mapInArrow(run, INDEX), "token-index")
    # A part starts where the parts before it end: one number a part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return materialize(written.join(starts, F.col("part") == F.col("of")).withColumn("first", F.col("first") + F.col("base")).drop("of", "base"), "token-blocks")


def read_files(blocks: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (packed little-endian u32) of all documents in blocks, rows of write_files()'s index.

    start is the number of the document's first token in the whole sequence. Neighbouring blocks are read and decoded
    together, about RANGE_BYTES at a time; a damaged block is a ValueError.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        known: dict[bytes, tuple[np.ndarray, int]] = {}

        def documents(name: str, rows: list[tuple[int, int, int]]) -> Iterator:
            """rows: offset, bytes and first token of neighbouring blocks."""
            with fs.open_input_file(f"{root}/{name}") as f:
                start = rows[0][0]
                head = f.read_at(struct.calcsize(HEAD), 0)
                head = f.read_at(struct.calcsize(HEAD) + struct.unpack(HEAD, head)[-1], 0)
                raw = f.read_at(rows[-1][0] + rows[-1][1] - start, start)
            if head not in known:
                known.clear()
                lengths, limit = parse_header(head)
                known[head] = decoding_table(lengths, limit), limit
            blocks = [parse_block(raw[at - start : at - start + n]) for at, n, _ in rows]
            decoded = decode([b[4] for b in blocks], [b[3] for b in blocks], [int(b[1].sum()) for b in blocks], *known[head])
            ids, starts, counts, values = [], [], [], []
            for (_, _, first), (doc_ids, n, *_), tokens in zip(rows, blocks, decoded, strict=True):
                ends = np.cumsum(n)
                packed = tokens.astype("<u4").tobytes()
                ids += doc_ids
                starts += (first + ends - n).tolist()
                counts += n.tolist()
                values += [packed[4 * a : 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, pa.binary())], [x.split()[0] for x in DOCUMENT.split(", ")])

        held, name, size = [], None, 0
        for b in batches:
            for file, offset, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (file != name or size + n > RANGE_BYTES or offset != held[-1][0] + held[-1][1]):
                    yield from documents(name, held)
                    held, size = [], 0
                name = file
                held.append((offset, n, first))
                size += n
        if held:
            yield from documents(name, held)

    total = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // (32 << 20)), min(4 * cores, -(-total // RANGE_BYTES)))
    dealt = blocks.select("file", "offset", "bytes", "first").repartition(tasks, "file", F.expr(f"offset div {RANGE_BYTES}"))
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, DOCUMENT)


def encode_and_read(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0) -> DataFrame:
    """write_files() into a fresh folder of the shared one, then read_files() of the whole index."""
    folder = fresh_path(docs.sparkSession, "token-files")
    return read_files(write_files(docs, tokenizer_path, folder, end_id=end_id), folder)
