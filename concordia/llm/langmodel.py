"""Language-model scoring with a log-frequency Bloom filter.

N-gram counts of the training rows are summed over the whole corpus as 64-bit hashes, quantised to levels
q = 1 + floor(log2(count)), and each n-gram is put into a Bloom filter once for every level up to its own. A query
probes level after level until one is missing, which returns the quantised count; unseen n-grams are mistaken for seen
ones at the filter's error rate only. All levels of an n-gram lie in one block of eight 64-bit words, one word a level,
so a query touches one place in memory. The filter consists of small segments chosen by the n-gram's hash, so segments
are built independently, in parallel, and its size is proportional to its entries.

A filter of at most ``max_bits`` is broadcast to the workers. A larger one stays in its segments and the probes go to
them: each text's distinct n-grams are shuffled to their segments and the levels found there back to the text. The
levels, and so the scores, are the same either way.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import discard, materialize

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit words of a block, and the most levels.
BLOCK, LEVELS = 8, 48
ONE, LOW = np.uint64(1), np.uint64(63)
#: Bytes from which a word is hashed by XXH64.
LONG = 1024
#: Hash of the history of a first token, no token's.
START = np.uint64(2)


@dataclass(frozen=True)
class Settings:
    #: Bits an entry (an n-gram at one level), and bits of a segment.
    bits_per_entry: int = 14
    segment_bits: int = 1 << 18
    #: The most of the filter that is broadcast, in bits; probes are shuffled to the segments of a larger one.
    max_bits: int = 1 << 31
    #: Weight of the unigram probability among a history's counts.
    mu: float = 300.0
    #: Tokens whose exact counts are broadcast, the most frequent first; all others are joined.
    hot_tokens: int = 1 << 18
    #: Bytes of text that are scored in one piece.
    batch_bytes: int = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigram(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The hash of a bigram is odd, that of a token even."""
    return mix(history * GOLDEN + token) | ONE


class Tokens:
    """Texts to token hashes without a step a word: words are runs of bytes in one buffer, hashed from prefix sums.

    A word's hash is the sum of value(byte) * P^place over its bytes, in 64-bit arithmetic, times P^-start (P is odd, so
    it has an inverse), and mixed. Such sums are equal for some long words whatever P is, so a word of LONG bytes or more
    is hashed by XXH64 instead. A-Z have the values of a-z. The end of a text is a word of the byte 0xFF, which is
    in no text in UTF-8. Buffers hold about ``window`` bytes, or one word where that is longer.
    """

    END_BYTE = 0xFF

    def __init__(self, window: int = 1 << 21):
        rng = np.random.default_rng(7)
        self.window = window
        self.value = rng.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.value[ord("A") : ord("Z") + 1] = self.value[ord("a") : ord("z") + 1]
        self.value[self.space] = 0
        self.base = np.uint64(0x9FB21C651E98DF25)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._powers(window + 64)
        self.end = self.hashes(bytes([self.END_BYTE]))[0]

    def _powers(self, n: int) -> None:
        self.up, self.down = (np.cumprod(np.concatenate([[ONE], np.full(n, p, np.uint64)])) for p in (self.base, self.inverse))

    def hashes(self, raw: bytes) -> np.ndarray:
        """The hash of every word of raw, in order."""
        if len(raw) > len(self.up):
            self._powers(len(raw))
        b = np.frombuffer(raw, np.uint8)
        edge = np.diff(self.space[b].view(np.int8), prepend=1, append=1)
        first, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.value[b] * self.up[: len(b)], out=sums[1:])
        out = mix((sums[stop] - sums[first]) * self.down[first] + (stop - first).astype(np.uint64) * GOLDEN)
        for k in np.flatnonzero(stop - first >= LONG).tolist():
            out[k] = xxhash.xxh64_intdigest(raw[first[k] : stop[k]].lower(), 7)
        return out & ~ONE

    def _cut(self, raw: bytes) -> Iterator[bytes]:
        """raw in parts of at most window bytes that end at white space, or at the end of a longer word."""
        at = 0
        while len(raw) - at > self.window:
            m = re.compile(rb"[ \t-\r]").search(raw, at + self.window)
            stop = max(raw.rfind(s, at, at + self.window) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            stop = stop + 1 if stop >= at else m.start() if m else len(raw)
            yield raw[at:stop]
            at = stop
        yield raw[at:]

    def documents(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes of all texts in a row, their ends included, and where each text ends."""
        mark = bytes([32, self.END_BYTE, 32])
        out, part, size = [], [], 0
        for t in texts:
            t = t or b""
            if size and size + len(t) > self.window:
                out.append(self.hashes(b"".join(part)))
                part, size = [], 0
            if len(t) > self.window:
                out += [self.hashes(x) for x in self._cut(t)]
                t = b""
            part += (t, mark)
            size += len(t) + 3
        out.append(self.hashes(b"".join(part)))
        tokens = np.concatenate(out)
        return tokens, np.flatnonzero(tokens == self.end) + 1


def _histories(tokens: np.ndarray, ends: np.ndarray, start) -> np.ndarray:
    """What stands before each token: the token before it, or start."""
    h = np.empty_like(tokens)
    h[1:] = tokens[:-1]
    h[np.concatenate([[0], ends[:-1]])] = start
    return h


def pieces(texts: list, size: int) -> Iterator[list]:
    """texts in order, cut into lists of about size characters or bytes; a longer text is a list of its own."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "") + 1
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def ngram_counts(docs: DataFrame, chunk_tokens: int = 4_000_000) -> DataFrame:
    """h (hash, signed; even of a token, odd of a bigram), c: exact counts of all tokens and bigrams of docs, up to collisions of 63 bits.

    Tasks count chunks of tokens before the shuffle; the shuffle is by hash, so no n-gram is a hot spot.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Tokens()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator:
            tokens = np.concatenate([t for t, _ in held])
            pairs = np.concatenate([bigram(_histories(t, e, START), t) for t, e in held])
            held.clear()
            for x in (tokens, pairs):
                x.sort()
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                h, c = x[first].view(np.int64), np.diff(np.append(first, len(x)))
                for at in range(0, len(h), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 18)]), pa.array(c[at : at + (1 << 18)], pa.int64())], ["h", "c"])

        for b in batches:
            for part in pieces(b.column(0).to_pylist(), words.window):
                held.append(words.documents(part))
                size += len(held[-1][0])
                if size >= chunk_tokens:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "h long, c long").repartition("h").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Filter:
    """The assembled filter, or a part of it: 64-bit words of its segments in a row, from segment first on."""

    words: np.ndarray
    segments: int
    segment_bits: int
    first: int = 0

    @staticmethod
    def segment(h: np.ndarray, segments: int) -> np.ndarray:
        """Which segment holds h."""
        return ((mix(h ^ GOLDEN) >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)

    @staticmethod
    def home(h: np.ndarray, segment_bits: int) -> np.ndarray:
        """The first word of h's block within its segment."""
        return (mix(h + GOLDEN) & np.uint64(segment_bits // 64 // BLOCK - 1)) * np.uint64(BLOCK)

    @staticmethod
    def probe(h: np.ndarray, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The word of its block that (h, level) looks at, and the four bits that must be set there."""
        x = (h ^ np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) * GOLDEN
        return ((h >> np.uint64(20)) + np.uint64(level)) & np.uint64(BLOCK - 1), [(x >> np.uint64(s)) & LOW for s in (58, 52, 46, 40)]

    def levels(self, h: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """The highest level up to which every probe of h hits, 0 for an unseen n-gram or one of another part; most bounds it."""
        own = self.segment(h, self.segments).astype(np.int64) - self.first
        out = np.zeros(len(h), np.int64)
        inside = (own >= 0) & (own < len(self.words) * 64 // self.segment_bits)
        i = np.flatnonzero(inside if most is None else inside & (most > 0))
        x, at = h[i], own[i] * (self.segment_bits // 64) + self.home(h[i], self.segment_bits).astype(np.int64)
        top = None if most is None else most[i]
        for level in range(1, LEVELS):
            if not len(i):
                break
            word, bits = self.probe(x, level)
            held = self.words[at + word.astype(np.int64)]
            hit = ((held >> bits[0]) & (held >> bits[1]) & (held >> bits[2]) & (held >> bits[3]) & ONE) == ONE
            out[i[hit]] = level
            if top is not None:
                hit &= top > level
                top = top[hit]
            i, x, at = i[hit], x[hit], at[hit]
        return out


def quantised(count: np.ndarray) -> np.ndarray:
    """The level of a count: 0 of 0, else 1 + floor(log2(count))."""
    return np.frexp(np.asarray(count, float))[1]


@dataclass(frozen=True)
class Totals:
    """What one pass over the counts tells: tokens, distinct tokens, entries of the filter, and the mean count of each level.

    means[0] is of tokens, means[1] of bigrams; with them, quantised counts sum to the true total of every level.
    """

    tokens: int
    vocabulary: int
    entries: int
    means: np.ndarray

    @staticmethod
    def of(counts: DataFrame) -> Totals:
        kind = F.col("h").bitwiseAND(F.lit(1)).cast("int").alias("k")
        rows = counts.groupBy(kind, _level().alias("q")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
        means = np.tile((1.5 * 2.0 ** np.arange(LEVELS + 1) - 1) / 2, (2, 1))
        means[:, 0] = 0
        for r in rows:
            means[r["k"], r["q"]] = r["c"] / r["n"]
        tokens = [r for r in rows if r["k"] == 0]
        return Totals(sum(r["c"] for r in tokens), sum(r["n"] for r in tokens), sum(r["n"] * r["q"] for r in rows), means)


def _level():
    return (F.floor(F.log2(F.col("c")) + 1e-9) + 1).cast("int")


def segment_rows(counts: DataFrame, entries: int, settings: Settings) -> tuple[DataFrame, int]:
    """Put every (n-gram, level) into its segment: segment, words of those with an entry, and the number of all segments."""
    bits = settings.segment_bits
    segments = max(1, -(-entries * settings.bits_per_entry // bits))

    def locate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            h = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(Filter.segment(h.view(np.uint64), segments).astype(np.int32)), b.column(0), b.column(1)], ["segment", "h", "q"])

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, own = -1, np.zeros(bits, np.uint8)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["segment", "words"])

        for b in batches:
            s, h, q = (c.to_numpy() for c in b.columns)
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if s[lo] != at:
                    if at >= 0:
                        yield row()
                    at = int(s[lo])
                    own[:] = 0
                x, levels = h[lo:hi].view(np.uint64), q[lo:hi]
                home = Filter.home(x, bits)
                for level in range(1, int(levels.max()) + 1):
                    has = levels >= level
                    word, places = Filter.probe(x[has], level)
                    word = (home[has] + word) * np.uint64(64)
                    for place in places:
                        own[(word + place).astype(np.int64)] = 1
        if at >= 0:
            yield row()

    located = counts.select("h", _level().alias("q")).mapInArrow(locate, "segment int, h long, q int")
    return located.repartition("segment").sortWithinPartitions("segment").mapInArrow(build, "segment int, words binary"), segments


def build_filter(counts: DataFrame, settings: Settings, entries: int | None = None) -> Filter:
    """The whole filter on the driver; its caller knows its size."""
    rows, segments = segment_rows(counts, Totals.of(counts).entries if entries is None else entries, settings)
    size = settings.segment_bits // 64
    whole = np.zeros(segments * size, np.uint64)
    for r in rows.toLocalIterator():
        whole[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["words"], np.uint64)
    return Filter(whole, segments, settings.segment_bits)


def probe_segments(probes: DataFrame, rows: DataFrame, segments: int, settings: Settings) -> DataFrame:
    """probes (key, h) with q, their levels in the filter of rows (segment, words); those of level 0 are left out.

    Probes are shuffled to their segments; each segment comes before its probes and is held alone.
    """

    def locate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            h = b.column(1).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(Filter.segment(h, segments).astype(np.int32)), b.column(0), b.column(1)], ["segment", "key", "h"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, own = -1, None
        for b in batches:
            s = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                bits = b.column(1)[lo].as_py()
                if bits is not None:  # the segment itself, which is its first row
                    at, own = int(s[lo]), Filter(np.frombuffer(bits, np.uint64), segments, settings.segment_bits, int(s[lo]))
                    lo += 1
                if s[hi - 1] != at or lo == hi:
                    continue  # a segment without an entry, or without a probe
                h = b.column(3).slice(lo, hi - lo)
                q = own.levels(h.to_numpy().view(np.uint64))
                found = pa.array(q > 0)
                yield pa.RecordBatch.from_arrays([b.column(2).slice(lo, hi - lo), h, pa.array(q.astype(np.int8))], ["key", "h", "q"]).filter(found)

    asked = probes.mapInArrow(locate, "segment int, key long, h long").select("segment", F.lit(None).cast("binary").alias("words"), "key", "h")
    both = rows.select("segment", "words", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("h")).unionAll(asked)
    by = [F.col("segment"), F.col("words").isNull()]
    return both.repartition("segment").sortWithinPartitions(*by).mapInArrow(run, "key long, h long, q byte")


@dataclass
class Model:
    """Probabilities from levels: Dirichlet smoothing of bigram counts by the add-one unigram model, with the mean count of each level."""

    totals: Totals
    mu: float
    #: The level of START, which is not in the filter: that of the number of training texts.
    start: int

    def log10(self, token: np.ndarray, history: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 P(token | history) from the levels of the token, its history and the bigram."""
        of_token, of_pair = self.totals.means
        unigram = (of_token[token] + 1) / (self.totals.tokens + self.totals.vocabulary + 1)
        seen = of_token[history]
        both = np.minimum(of_pair[pair], np.minimum(of_token[token], seen))
        return np.log10((both + self.mu * unigram) / (seen + self.mu))


class Scorer:
    """Base scores and model scores of texts; hot and exact are the sorted hashes of the hot tokens and their counts."""

    def __init__(self, model: Model, hot: np.ndarray, exact: np.ndarray):
        self.model, self.hot, self.words = model, hot, Tokens()
        self.base = np.log10((exact + 1) / (model.totals.tokens + model.totals.vocabulary + 1))

    def __call__(self, texts: list[bytes | None], levels: Callable) -> tuple:
        """n_tokens, hot_known, hot_base, score, rest of each text; levels(hashes, most) gives the levels of n-grams.

        Each distinct token and each distinct bigram of texts is looked up once.
        """
        tokens, ends = self.words.documents(texts)
        starts = np.concatenate([[0], ends[:-1]])
        names, token = np.unique(tokens, return_inverse=True)
        level = np.append(levels(names, None), self.model.start)
        known, base = np.zeros(len(names), bool), np.zeros(len(names))
        if len(self.hot):
            place = np.minimum(np.searchsorted(self.hot, names), len(self.hot) - 1)
            known = self.hot[place] == names
            base = np.where(known, self.base[place], 0.0)
        hashes, width = np.append(names, START), len(names) + 1
        pair, inverse = np.unique(_histories(token, ends, len(names)) * width + token, return_inverse=True)
        h, t = np.divmod(pair, width)
        q = levels(bigram(hashes[h], hashes[t]), np.minimum(level[h], level[t]))
        logp = self.model.log10(level[t], level[h], q)[inverse]
        hit = known[token]
        missing = np.flatnonzero(~hit)
        cuts = np.searchsorted(missing, np.concatenate([[0], ends]))
        rest = tokens[missing].view(np.int64)
        return ends - starts, np.add.reduceat(hit.astype(np.int64), starts), np.add.reduceat(base[token], starts), np.add.reduceat(logp, starts), (cuts, rest)


SCORED = "doc_id long, key long, n_tokens long, hot_known long, hot_base double, score double, rest array<long>"


def _scored_batch(ids, keys, found: tuple):
    import pyarrow as pa

    n, known, base, score, (cuts, rest) = found
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rest, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, keys, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), lists], [x.split()[0] for x in SCORED.split(", ")])


def _score_by_broadcast(read: DataFrame, shared, settings: Settings) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        scorer, whole = Scorer(*shared.value[:3]), shared.value[3]
        for b in batches:
            at = 0
            for part in pieces(b.column(2).to_pylist(), settings.batch_bytes):
                yield _scored_batch(b.column(0).slice(at, len(part)), b.column(1).slice(at, len(part)), scorer(part, whole.levels))
                at += len(part)

    return read.mapInArrow(run, SCORED)


def _score_by_routes(read: DataFrame, shared, rows: DataFrame, segments: int, settings: Settings) -> DataFrame:
    """As _score_by_broadcast(), with a filter that stays in its segments.

    Each text's distinct n-grams are probed where their segments are. The levels of the hot ones, which would be asked
    for by most texts, are looked up once and broadcast.
    """
    import pandas as pd

    hot = pd.DataFrame({"key": 0, "h": shared.value[4].view(np.int64)})
    known = probe_segments(read.sparkSession.createDataFrame(hot, "key long, h long"), rows, segments, settings).toPandas()
    order = np.argsort(known["h"].to_numpy(np.int64).view(np.uint64))
    common = read.sparkSession.sparkContext.broadcast((known["h"].to_numpy(np.int64).view(np.uint64)[order], known["q"].to_numpy(np.int64)[order], np.sort(shared.value[4])))

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, asked = Tokens(), common.value[2]
        for b in batches:
            for key, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tokens, ends = words.documents([text])
                h = np.unique(np.concatenate([tokens, bigram(_histories(tokens, ends, START), tokens)]))
                if len(asked):
                    h = h[asked[np.minimum(np.searchsorted(asked, h), len(asked) - 1)] != h]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), key), pa.int64()), pa.array(h.view(np.int64))], ["key", "h"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer, at, own = Scorer(*shared.value[:3]), None, []
        often, level = common.value[:2]

        def levels(h: np.ndarray, most: np.ndarray | None) -> np.ndarray:
            out = np.zeros(len(h), np.int64)
            for names, q in ((often, level), table):
                if len(names):
                    place = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    out = np.where(names[place] == h, q[place], out)
            return out if most is None else np.minimum(out, most)

        for b in batches:
            keys, texts, h, q = (b.column(i) for i in (1, 2, 3, 4))
            key = keys.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if key[lo] != at:
                    at, own = int(key[lo]), []
                level_rows = int(q.slice(lo, hi - lo).null_count)
                stop = hi - level_rows  # levels come before the texts of their key
                if stop > lo:
                    own.append((h.slice(lo, stop - lo).to_numpy().view(np.uint64), q.slice(lo, stop - lo).to_numpy()))
                if not level_rows:
                    continue
                names = np.concatenate([x for x, _ in own]) if own else np.zeros(0, np.uint64)
                place = np.argsort(names)
                table = names[place], np.concatenate([x for _, x in own]).astype(np.int64)[place] if own else np.zeros(0, np.int64)
                part = texts.slice(stop, level_rows).to_pylist()
                yield _scored_batch(b.column(0).slice(stop, level_rows), keys.slice(stop, level_rows), scorer(part, levels))

    found = probe_segments(read.mapInArrow(ask, "key long, h long"), rows, segments, settings)
    none = F.lit(None)
    both = read.select("doc_id", "key", "text", none.cast("long").alias("h"), none.cast("byte").alias("q")).unionAll(found.select(none.cast("long"), "key", none.cast("binary"), "h", "q"))
    return both.repartition("key").sortWithinPartitions("key", F.col("q").isNull()).mapInArrow(run, SCORED)


def score(docs: DataFrame, *, train: str = "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2", settings: Settings | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text (null: empty).

    Training rows are those where the SQL condition train holds (not null). Counts cover all of them and grow with the
    corpus; the base score uses exact counts: the hot_tokens most frequent are broadcast, the others are joined by hash
    after the scoring pass, so ties at that bound change nothing. Repeated rows give repeated results; rows of one
    doc_id with different texts are told apart by the text's hash. A text of any length is scored in one piece. Without
    training rows the base score is 0 and so is the score's evidence: every count is 0. Only doc_id, text and what
    train names are read, so other columns cannot clash. An empty table gives an empty one.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    counts = materialize(ngram_counts(docs.where(f"coalesce({train}, false)")), "ngrams")
    totals = Totals.of(counts)
    even = F.col("h").bitwiseAND(F.lit(1)) == 0
    unigrams = counts.where(even)
    hot = unigrams.orderBy(F.desc("c"), "h").limit(settings.hot_tokens).toPandas()
    end = int(Tokens().end.view(np.int64))
    texts = (unigrams.where(F.col("h") == end).first() or {"c": 0})["c"]
    model = Model(totals, settings.mu, int(quantised(texts)))
    hot_h = hot["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot_h)
    known = model, hot_h[order], hot["c"].to_numpy(np.int64)[order]
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key")
    read = docs.select(F.col("doc_id").cast("long"), key, F.col("text").cast("string").cast("binary").alias("text"))
    if totals.entries * settings.bits_per_entry <= settings.max_bits:
        shared = spark.sparkContext.broadcast((*known, build_filter(counts, settings, totals.entries)))
        scored = materialize(_score_by_broadcast(read, shared, settings), "scored")
        shared.unpersist()
    else:
        often = counts.orderBy(F.desc("c"), "h").limit(settings.hot_tokens).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
        rows, segments = segment_rows(counts, totals.entries, settings)
        rows = materialize(rows, "segments")
        shared = spark.sparkContext.broadcast((*known, None, often))
        scored = materialize(_score_by_routes(read, shared, rows, segments, settings), "scored")
        discard(rows)
    rare = scored.where(F.size("rest") > 0).select("doc_id", "key", "rest").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.explode("rest").alias("h"))
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 1) / F.lit(float(totals.tokens + totals.vocabulary + 1)))
    found = rare.join(unigrams, "h", "left").groupBy("doc_id", "key").agg(F.sum(base).alias("rare_base"), F.sum((c > 0).cast("long")).alias("rare_known"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "rare_base", "rare_known")
    out = scored.drop("rest").join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return out.select("doc_id", "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"), (F.col("hot_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score")


__all__ = ["Filter", "Model", "Settings", "Tokens", "Totals", "bigram", "build_filter", "ngram_counts", "probe_segments", "quantised", "score", "segment_rows"]
