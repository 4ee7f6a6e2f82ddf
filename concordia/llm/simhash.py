"""SimHash near-duplicates: fingerprints of 64 bits or several times 64, linked through a table of pivot distances.

The table holds each fingerprint's Hamming distances to reference fingerprints: a base reference, the base with one
short segment flipped (one reference a segment), and some at random. By the triangle inequality no distance to a
reference differs by more than d(x, y) between x and y, and the difference of the distances to the base and to a
flipped base tells the distance within that segment. Segments form ``limit + 1`` bands; fingerprints with at most
``limit`` differing bits have one band without a difference, so all its coordinates agree. Rows that agree on a band's
coordinates meet, pairs with a coordinate difference above limit are discarded, and survivors are verified.

``near_duplicates()`` links 64-bit fingerprints of shingles and finds every pair within its limit. ``near_copies()``
links texts whose 5-word shingle sets have a Jaccard similarity of 0.8 or more: such texts differ in few words, so it
takes the SimHash of the distinct words in several lanes of 64 bits, each with a table of its own, and verifies what
survives on the whole sets. No fingerprint bounds that similarity, so the prefixes of the sets then give every pair
that the fingerprints have left apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import discard, materialize
from concordia.llm.components import Forest, components, contracted
from concordia.llm.langmodel import GOLDEN, Tokens, mix

SEED = 42
#: Rows of one bucket that are compared in one piece; a larger bucket is compared as pairs of chunks of this size.
BLOCK = 4096
#: Rows of whole groups that a task holds at a time, if a group has no more.
PIECE = 32_768
#: Similarity of near copies as a fraction; comparisons are made in integers.
OVER, UNDER = 4, 5
#: Lanes of 64 bits of the words' fingerprint, and the most of all their bits in which candidates differ: texts of
#: similarity 0.8 differ in about 7 bits of 100.
LANES, LANES_LIMIT = 6, 60
#: Texts whose shingles are counted to order the sets: so many at least, one of EVERY in a large corpus; and the most shingles that are told apart.
SAMPLE, EVERY, FREQUENT = 8192, 64, 1 << 17
#: Rows up to which buckets are compared together, step by step.
SMALL = 64
#: Bits of the bitmap of the texts that are read to verify pairs.
MARKS = 1 << 23
#: The most bits of a set's sketch where sets meet, and where pairs are told apart before whole sets are read.
SKETCH, WIDE = 1 << 10, 1 << 15


class Pivots:
    """References for 64-bit fingerprints: bands of segments of ``width`` bits, and ``extra`` random ones."""

    def __init__(self, limit: int = 2, width: int = 1, extra: int = 12, seed: int = 64):
        rng = np.random.default_rng(seed)
        self.limit = limit
        self.base = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        cuts = [round(64 * k / (limit + 1)) for k in range(limit + 2)]
        #: For each band, the (mask, length) of its segments.
        self.bands = [[(sum(1 << i for i in range(s, min(s + width, b))), min(s + width, b) - s) for s in range(a, b, width)] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.extra = rng.integers(0, 1 << 63, size=extra, dtype=np.uint64) * np.uint64(2)

    def base_distance(self, x: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ self.base)

    def far(self, x: np.ndarray) -> np.ndarray:
        """Distances to the random references, a row a reference."""
        return np.stack([np.bitwise_count(x ^ p) for p in self.extra]) if len(self.extra) else np.zeros((0, len(x)), np.uint8)

    def band_keys(self, x: np.ndarray) -> list[np.ndarray]:
        """One number a band for the distances within its segments, told by the distances to base and flipped base."""
        d0, out = self.base_distance(x).astype(np.int64), []
        for segments in self.bands:
            key = np.zeros(len(x), np.int64)
            for mask, n in segments:
                flipped = np.bitwise_count(x ^ (self.base ^ np.uint64(mask))).astype(np.int64)
                key = key * (n + 1) + (d0 - flipped + n) // 2
            out.append(key)
        return out


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text; see fingerprints()."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text, repeated rows and null ids included.

    A-Z are lower-cased, words are runs of anything but the six ASCII separators, shingles are joined by a space and
    hashed by XXH64 with seed 42; fewer words than a shingle count as one shingle, none (or null) give zero.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _compare(pivots: Pivots, group: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges between the fingerprints of each group that are at most limit bits apart."""
    d0 = pivots.base_distance(fp).astype(np.int16)
    order = np.lexsort((d0, group))
    group, fp, rep, d0 = group[order], fp[order], rep[order], d0[order]
    far = pivots.far(fp).astype(np.int16)
    forest, i, step = Forest(len(fp)), np.arange(len(fp)), 0
    while True:  # pairs at distance step in the order; the base distance is sorted, so a row drops out at the first excess
        step += 1
        i = i[i + step < len(fp)]
        i = i[(group[i] == group[i + step]) & (d0[i + step] - d0[i] <= pivots.limit)]
        if not len(i):
            break
        a = i
        for row in far:
            a = a[np.abs(row[a] - row[a + step]) <= pivots.limit]
            if not len(a):
                break
        a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= pivots.limit]
        forest.union(a, a + step)
    return forest.stars(rep)


def _by_group(sorted_rows: DataFrame, schema: str, work) -> DataFrame:
    """work(table, group numbers) for the groups (band, key, bi, bj) of rows that are sorted by them, streamed in bounded pieces."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[pa.Table] = []

        def call(t: pa.Table) -> Iterator:
            t = t.combine_chunks()
            new = np.zeros(t.num_rows, bool)
            for c in ("band", "key", "bi", "bj"):
                x = t.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            return work(t, np.cumsum(new))

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < PIECE:
                continue
            t = pa.concat_tables(held)
            same = np.ones(t.num_rows, bool)
            for c in ("band", "key", "bi", "bj"):
                x = t.column(c).to_numpy()
                same &= x == x[-1]
            cut = int(np.argmax(same))  # where the last group, which may go on, begins
            if cut:
                yield from call(t.slice(0, cut))
            held = [t.slice(cut)]
        if held:
            yield from call(pa.concat_tables(held))

    return sorted_rows.mapInArrow(run, schema)


def _dealt(banded: DataFrame, block: int, salt: str) -> DataFrame:
    """banded (band, key, salt, ...) with bi, bj, sorted by band, key, bi, bj in its partitions.

    A bucket of more than block rows is dealt into chunks by a hash of salt, and every pair of chunks meets in a block
    of its own: nothing is dropped and no task holds more than two chunks at a time.
    """
    large = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n_bucket")).where(F.col("n_bucket") > block)
    chunks = F.coalesce(F.ceil(F.col("n_bucket") / block), F.lit(1)).cast("int")
    dealt = banded.join(large, ["band", "key"], "left").withColumn("nc", chunks).withColumn("c", F.pmod(F.xxhash64(salt, F.lit(7)), F.col("nc")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).withColumn("bi", F.least("c", "o")).withColumn("bj", F.greatest("c", "o")).drop("n_bucket", "nc", "c", "o")
    by = ["band", "key", "bi", "bj"]
    return dealt.repartition(*by).sortWithinPartitions(*by)


def links(distinct: DataFrame, *, limit: int = 2, width: int = 1, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of a forest that joins all of distinct's (rep, fp) rows at most limit bits apart."""
    pivots = Pivots(limit, width)

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fp = b.column(1).to_numpy().view(np.uint64)
            for band, key in enumerate(pivots.band_keys(fp)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), band, np.int32)), pa.array(key, pa.int64()), b.column(1), b.column(0)], ["band", "key", "fp", "rep"])

    def work(t, group: np.ndarray) -> Iterator:
        import pyarrow as pa

        a, b = _compare(pivots, group, t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    banded = distinct.select("rep", "fp").mapInArrow(keys, "band int, key long, fp long, rep long")
    return _by_group(_dealt(banded, block, "fp"), "a long, b long", work)


def near_duplicates(docs: DataFrame, *, shingle: int = 3, limit: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row: the least doc_id reachable by links of at most limit differing bits.

    Links are found between distinct fingerprints, of rows without an id as well; rows of equal fingerprints are never
    paired. A row with a null doc_id gets its component's least doc_id, null when no row of the component has an id.
    Texts of any length are read whole and repeated rows are equal fingerprints. An empty table gives an empty one; clashing column names cannot disturb, as only doc_id
    and text are read.
    """
    fps = materialize(fingerprints(docs, shingle=shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select(F.col("fp").alias("rep"), "fp"), limit=limit))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    named = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    return fps.join(grouped.join(named, "group").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(words: np.ndarray, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles from its word hashes; fewer words count as one shingle, none as none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(shingle, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * GOLDEN + words[k : k + len(h)])
    return np.unique(h)


def words_fingerprint(words: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The SimHash of a text's distinct words, 64 bits a lane."""
    own, out = np.unique(words), np.zeros(lanes, np.uint64)
    for k in range(lanes):
        h, ones = mix(own ^ (GOLDEN * np.uint64(2 * k + 1))), np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return out


def sketch(s: np.ndarray, most: int = WIDE) -> bytes:
    """How many of a set's members end in each number, odd or even: a bit each, at most most bits.

    A member that only one of two sets has turns one bit, so the sets differ in at least as many members as their
    sketches in bits. The halves of a sketch, one over the other, are that of half the bits. Sets of 0.8 differ in 2
    of 9 members of both, so a few bits a member tell most others; large sets have one or two.
    """
    size = 1 << max(len(s) - 1, 0).bit_length()
    bits = min(most, max(256, size, min(4 * size, SKETCH)))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: bytes, most: int) -> bytes:
    """The sketch of at most most bits that is in a longer one."""
    if 8 * len(x) <= most:
        return x
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, most // 64), axis=0).tobytes()


class Sketches:
    """The sketches of rows, an Arrow array of binaries, which tell pairs that can't be similar."""

    def __init__(self, found):
        at = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int32)
        self.flat = np.frombuffer(found.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(np.uint64)
        self.starts = (at - at[0]).astype(np.int64) // 8
        self.words = np.diff(self.starts)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many members the sets of rows x and y differ at least."""
        out = np.zeros(len(x), np.int64)
        sizes = self.words[x] * WIDE + self.words[y]
        for both in np.unique(sizes).tolist():
            a, b = divmod(both, WIDE)
            of_both = np.flatnonzero(sizes == both)
            for start in range(0, len(of_both), BLOCK):
                i = of_both[start : start + BLOCK]
                u, v = (np.bitwise_xor.reduce(self.flat[self.starts[z[i]][:, None] + np.arange(w)].reshape(len(i), -1, min(a, b)), axis=1) for w, z in ((a, x), (b, y)))
                out[i] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
        return out


def _name(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _word_lists(texts: list[bytes | None], tokens: Tokens) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for at in range(0, len(texts), 256):
        found, ends = tokens.documents(texts[at : at + 256])
        start = 0
        for e in ends.tolist():
            yield found[start : e - 1]  # without the end
            start = e


def _candidates(tables: list[Pivots], limit: int, group: np.ndarray, fp: np.ndarray, n: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that connects, in each group, all rows at most limit bits apart whose sizes allow the similarity.

    Near pairs come first. fp has a row for each lane.
    """
    d0 = sum(t.base_distance(x).astype(np.int32) for t, x in zip(tables, fp, strict=True))
    order = np.lexsort((d0, group))
    group, fp, n, name, d0 = group[order], fp[:, order], n[order].astype(np.int64), name[order], d0[order]
    far = sum(t.far(x).astype(np.int32) for t, x in zip(tables, fp, strict=True))
    forest, a, b = Forest(len(group)), [], []
    for most in (limit // 4, limit // 2, limit):
        i, step = np.arange(len(group)), 0
        while True:  # pairs at distance step in the order; the base distance is sorted, so a row drops out at the first excess
            step += 1
            i = i[i + step < len(group)]
            i = i[(group[i] == group[i + step]) & (d0[i + step] - d0[i] <= most)]
            if not len(i):
                break
            x = i[(UNDER * np.minimum(n[i], n[i + step]) >= OVER * np.maximum(n[i], n[i + step])) & (forest.roots(i) != forest.roots(i + step))]
            for row in far:
                if not len(x):
                    break
                x = x[np.abs(row[x] - row[x + step]) <= most]
            x = x[np.bitwise_count(fp[:, x] ^ fp[:, x + step]).sum(axis=0, dtype=np.int32) <= most]
            if len(x):
                forest.union(x, x + step)
                a.append(name[x])
                b.append(name[x + step])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first members of a sorted set of shingles, of which similar sets share one, whatever the order.

    Members that frequent (sorted) doesn't have come first, others by rank, each by their hash. Sets of similarity 0.8
    share 4/5 of either's members, so that many less one may be left out.
    """
    if len(frequent) and len(s):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        s = s[np.argsort(np.where(frequent[at] == s, rank[at], 0), kind="stable")]
    return s[: len(s) - -(-OVER * len(s) // UNDER) + 1] if len(s) else s


def _open_pairs(group: np.ndarray, n: np.ndarray, pos: np.ndarray, name: np.ndarray, joined: np.ndarray, small: int = SMALL, sketches: Sketches | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of names in a group that may be similar and have different joined, in pieces.

    A group has the sets whose prefixes have one member, pos its place in the set. What comes before the first common
    member is in one set only: that bounds the common members. A pair that fails at a later one passes at the first.
    With sketches, a pair whose sketches differ in too many bits is left out.
    In a group of more than small rows those of the largest joined aren't compared with each other.
    """
    order = np.lexsort((n, group))
    row = order
    group, n, pos, name, joined = group[order], n[order].astype(np.int64), pos[order].astype(np.int64), name[order], joined[order]

    def may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = n[x] + n[y]
        ok = (joined[x] != joined[y]) & ((OVER + UNDER) * (pos[x] + pos[y]) <= (UNDER - OVER) * both)
        ok &= (OVER + UNDER) * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= OVER * both
        if sketches is not None:
            i = np.flatnonzero(ok)
            ok[i] = (OVER + UNDER) * sketches.differ(row[x[i]], row[y[i]]) <= (UNDER - OVER) * both[i]
        return ok

    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    i, step = np.flatnonzero(np.repeat(sizes <= small, sizes)), 0
    while True:  # pairs at distance step in the order; sizes are sorted, so a row drops out at the first excess
        step += 1
        i = i[i + step < len(group)]
        i = i[(group[i] == group[i + step]) & (UNDER * n[i] >= OVER * n[i + step])]
        if not len(i):
            break
        x = i[may(i, i + step)]
        yield name[x], name[x + step]
    for start, size in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        every = np.arange(start, start + size)
        values, counts = np.unique(joined[every], return_counts=True)
        in_most = joined[every] == values[np.argmax(counts)]
        most, rest = every[in_most], every[~in_most]
        for k, x in enumerate(rest):
            least, greatest = -(-OVER * n[x] // UNDER), UNDER * n[x] // OVER
            of_most = most[np.searchsorted(n[most], least) : np.searchsorted(n[most], greatest, "right")]
            of_rest = rest[k + 1 : np.searchsorted(n[rest], greatest, "right")]
            y = np.concatenate([of_most, of_rest])
            y = y[may(np.full(len(y), x), y)]
            if len(y):
                yield np.full(len(y), name[x]), name[y]


def _pieces(pairs: Iterator[tuple[np.ndarray, np.ndarray]], rows: int = 100_000) -> Iterator:
    """Batches (a, b) of pairs, the lesser name first, about rows at a time, each pair once in a batch."""
    import pyarrow as pa

    def batch(held: list) -> pa.RecordBatch:
        x, y = (np.concatenate(c) for c in zip(*held, strict=True))
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        once = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        x, y = x[once], y[once]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    held, size = [], 0
    for x, y in pairs:
        if not len(x):
            continue
        held.append((x, y))
        size += len(x)
        if size >= rows:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _frequent(read: DataFrame, texts: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more of a sample's different texts, sorted, with a rank that grows with their count.

    They only order the members of sets, so that buckets are small: any sample gives the same links.
    """

    def explode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = Tokens()
        for b in batches:
            for words in _word_lists(b.column(0).to_pylist(), tokens):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(words, shingle).view(np.int64), pa.int64())], ["key"])

    every = min(EVERY, max(1, texts // SAMPLE))
    sample = read.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
    counts = sample.mapInArrow(explode, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    key, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], (1 + np.log2(n[order])).astype(np.int8)


def _meeting(batches: Iterator) -> Iterator:
    """Of rows (key, name, pos) sorted by key and name, those whose key has several names, each name of a key once."""
    import pyarrow as pa

    last, met = None, False  # the last row so far, and whether the one before it has its key
    for b in batches:
        key, name, pos = (b.column(c).to_numpy() for c in range(3))
        if last is not None:
            key, name, pos = (np.concatenate([[x], c]).astype(c.dtype) for x, c in zip(last, (key, name, pos), strict=True))
        if not len(key):
            continue
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        key, name, pos = key[once], name[once], pos[once]
        same = np.concatenate([[met], key[1:] == key[:-1]])
        out = (same[:-1] | same[1:]) if len(key) > 1 else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][out], t) for c, t in ((key, pa.int64()), (name, pa.int64()), (pos, pa.int32()))], ["key", "name", "pos"])
        last, met = (key[-1], name[-1], pos[-1]), bool(same[-1])
    if met:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["key", "name", "pos"])


def near_copies(docs: DataFrame, *, shingle: int = 5, lanes: int = LANES, limit: int = LANES_LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, component_id of every row: the least doc_id reachable by links of Jaccard similarity 0.8 or more.

    Every link is verified on the whole sets of word shingles, and none is left out. Candidates come twice: first a
    forest over texts whose words' fingerprints agree in a band of some lane and differ in at most limit bits; then all
    pairs of sets in different components whose prefixes meet, as those of similar sets always do, and whose sketches
    don't tell that they differ too much.
    Words are as in fingerprints(); texts without words, null ones too, are equal, and so are texts of equal sets,
    which meet once. A row with a null doc_id gets the component of its set, which is null when no row of the component
    has an id. Repeated rows are equal texts. A text of any length is read whole; only doc_id and text are read, so
    other columns cannot clash. An empty table gives an empty one.
    """
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    tables = [Pivots(2, 1, seed=64 + k) for k in range(lanes)]

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = Tokens()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                names, sizes, prints, wide = [], [], [], []
                for words in _word_lists(b.column(1).to_pylist(), tokens):
                    s = shingle_set(words, shingle)
                    names.append(_name(s))
                    sizes.append(len(s))
                    prints.append(words_fingerprint(words, lanes).tobytes())
                    wide.append(sketch(s))
                arrays = [b.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), pa.array(wide, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "name", "n", "fp", "wide"])

    signed = materialize(read.mapInArrow(sign, "doc_id long, name long, n int, fp binary, wide binary"), "signed")
    distinct = materialize(signed.groupBy("name").agg(*(F.first(c).alias(c) for c in ("n", "fp", "wide")), F.min("doc_id").alias("rep")), "distinct")

    def pair() -> DataFrame:
        """Candidates (a, b) by fingerprints."""

        def keys(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                fp = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, lanes)
                for lane, table in enumerate(tables):
                    for band, key in enumerate(table.band_keys(fp[:, lane])):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), lane * len(table.bands) + band, np.int32)), pa.array(key, pa.int64()), *b.columns], ["band", "key", *b.schema.names])

        def work(t, group: np.ndarray) -> Iterator:
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, lanes)
            return _pieces(iter([_candidates(tables, limit, group, np.ascontiguousarray(fp.T), t.column("n").to_numpy(), t.column("name").to_numpy())]))

        banded = distinct.where("n > 0").select("name", "n", "fp").mapInArrow(keys, "band int, key long, name long, n int, fp binary")
        return materialize(_by_group(_dealt(banded, block, "name"), "a long, b long", work).distinct(), "pairs")

    def pair_rest(roots: DataFrame) -> DataFrame:
        """All candidates (a, b) by prefixes that roots (node, root) hasn't joined."""
        frequent, rank = _frequent(read, signed.count(), shingle)

        def prefixes(batches: Iterator) -> Iterator:
            import pyarrow as pa

            tokens, seen = Tokens(), set()
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    names, found = [], []
                    for words in _word_lists(b.column(0).slice(at, 256).to_pylist(), tokens):
                        s = shingle_set(words, shingle)
                        if (name := _name(s)) not in seen:
                            seen.add(name)
                            names.append(name)
                            found.append(prefix(s, frequent, rank))
                    if names:
                        long = [len(x) for x in found]
                        arrays = [np.concatenate(found).view(np.int64), np.repeat(np.array(names, np.int64), long), np.concatenate([np.arange(k, dtype=np.int32) for k in long])]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "name", "pos"])

        def shorten(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                short = [folded(x, SKETCH) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(short, pa.binary()), b.column(3)], ["name", "n", "sketch", "joined"])

        def work(t, group: np.ndarray) -> Iterator:
            sketches = Sketches(t.column("sketch").combine_chunks())
            return _pieces(_open_pairs(group, *(t.column(c).to_numpy() for c in ("n", "pos", "name", "joined")), sketches=sketches))

        rows = read.select("text").mapInArrow(prefixes, "key long, name long, pos int")
        met = materialize(rows.repartition("key").sortWithinPartitions("key", "name").mapInArrow(_meeting, "key long, name long, pos int"), "met")
        known = distinct.join(roots, distinct["name"] == roots["node"], "left").select("name", "n", "wide", F.coalesce("root", "name").alias("joined"))
        known = known.mapInArrow(shorten, "name long, n int, sketch binary, joined long")
        banded = materialize(met.join(known, "name").select(F.lit(0).alias("band"), "key", "name", "pos", "n", "sketch", "joined"), "banded")
        discard(met)
        pairs = materialize(_by_group(_dealt(banded, block, "name"), "a long, b long", work).distinct(), "pairs")
        discard(banded)
        return pairs

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) without those whose sketches differ too much."""

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    sketches = Sketches(pa.concat_arrays(b.columns[4:6]))
                    differ = sketches.differ(np.arange(b.num_rows), np.arange(b.num_rows) + b.num_rows)
                    near = (OVER + UNDER) * differ <= (UNDER - OVER) * (b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy())
                    yield pa.RecordBatch.from_arrays([x.filter(pa.array(near)) for x in b.columns[:2]], ["a", "b"])

        of = lambda side: distinct.select(F.col("name").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"of_{side}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "of_a", "of_b")
        return materialize(both.mapInArrow(run, "a long, b long"), "alike")

    def judge(pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs (a, b). Reads the texts of one doc_id for each set; a row that comes twice only repeats a pair.

        A bitmap of fixed size of the doc_ids tells which texts to read, so that texts are not shuffled; where it says
        yes for others, too, their sets meet no pair.
        """
        needed = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
        bit = distinct.join(needed, "name", "left_semi").select(F.pmod(F.xxhash64("rep"), F.lit(MARKS)).alias("bit"))
        words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
        marks = np.zeros(MARKS // 64, np.int64)
        marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()

        def whole(batches: Iterator) -> Iterator:
            import pyarrow as pa

            tokens = Tokens()
            for b in batches:
                bit = b.column(0).to_numpy()
                texts = b.column(1).filter(pa.array((marks[bit >> 6] >> (bit & 63)) & 1 == 1))
                for at in range(0, len(texts), 256):
                    sets = [shingle_set(words, shingle) for words in _word_lists(texts.slice(at, 256).to_pylist(), tokens)]
                    ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                    members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), members], ["name", "members"])

        marked = read.select(F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).alias("bit"), "text")
        sets = materialize(marked.mapInArrow(whole, "name long, members array<long>"), "sets")
        of = lambda side: sets.select(F.col("name").alias(side), F.col("members").alias(f"of_{side}"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        similar = (OVER + UNDER) * both >= OVER * (F.size("of_a") + F.size("of_b"))
        judged = materialize(pairs.join(of("a"), "a").join(of("b"), "b").where(similar).select("a", "b"), "judged")
        discard(sets)
        return judged

    def linked(pairs: DataFrame) -> DataFrame:
        near = alike(pairs)
        discard(pairs)
        found = judge(near)
        discard(near)
        return found

    by_print = linked(pair())
    by_prefix = linked(pair_rest(materialize(components(contracted(by_print)), "roots")))
    roots = materialize(components(contracted(by_print.unionByName(by_prefix))), "roots")
    discard(distinct)
    group = F.coalesce("root", "name").alias("group")
    in_group = signed.join(roots, signed["name"] == roots["node"], "left").select("doc_id", group)
    least = in_group.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return in_group.join(least, "group").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One row of docs for each group of near_copies(): that of the least doc_id. Rows with a null doc_id are kept."""
    return one_of_each(docs, near_copies(docs, **how))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its component_id in found (doc_id, component_id), each doc_id once, and those without a doc_id.

    found has the ids of docs. A bitmap of fixed size tells which ids may have a row that goes; others stay without being shuffled.
    """
    found = materialize(found, "found")
    keep = materialize(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__keep")).agg(F.count(F.lit(1)).alias("__n")), "keep")
    repeated = keep.where("__n > 1")
    doubtful = found.where("not doc_id <=> component_id and doc_id is not null").select("doc_id").union(repeated.select("__keep"))
    bit = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(MARKS))
    marks = doubtful.select(bit("doc_id").alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__bit & 63 as int)))").alias("__bits"))
    marked = docs.withColumn("__bit", bit("doc_id")).join(F.broadcast(marks), F.shiftright("__bit", 6) == F.col("__word"), "left")
    marked = marked.withColumn("__doubt", F.expr("doc_id is not null and coalesce(shiftright(__bits, cast(__bit & 63 as int)) & 1L = 1L, false)")).drop("__bit", "__bits", "__word")
    sure = marked.where("not __doubt").drop("__doubt")
    joined = marked.where("__doubt").drop("__doubt").join(keep, F.col("doc_id") == F.col("__keep"))
    once = sure.unionByName(joined.where("__n = 1").drop("__keep", "__n"))
    if repeated.isEmpty():
        return once
    return once.unionByName(joined.where("__n > 1").drop("__keep", "__n").dropDuplicates(["doc_id"]))
