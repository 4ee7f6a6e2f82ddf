"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Windows of 2^j words get names that are equal exactly where the windows are: a window's name is the rank of its halves'
pair of names. The longest common extension of two places is read off by descending levels, one comparison a level. A
run of period q and length 2q or more holds two neighbouring points of the grid 0, q, 2q, ...; so every run is found by
extending such a pair to both sides, and only pairs whose words agree are extended. Many texts are searched at once,
with a word of its own between any two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, and bytes, that are searched together (a longer text is searched alone), and grid pairs that are extended together.
BATCH_WORDS, BATCH_BYTES, PAIRS = 1 << 19, 1 << 24, 1 << 18


def names(symbols: np.ndarray) -> list[np.ndarray]:
    """Level j: the names of all windows of 2^j symbols; no window of twice the last level's length is there twice.

    Windows that are there once needn't be sorted: they get names of their own, and so do those that hold one of them.
    """
    n, step = len(symbols), 1
    levels = [symbols.astype(np.int32)]
    shared = np.bincount(symbols)[symbols] > 1
    while 2 * step <= n:
        at = np.flatnonzero(shared[: n - step] & shared[step:])
        if not len(at):
            break
        last = levels[-1]
        pair = last[at] * np.int64(2 * n) + last[at + step]
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        first = np.ones(len(at), bool)
        first[1:] = pair[1:] != pair[:-1]
        name = np.cumsum(first) - 1
        size = np.bincount(name)
        if size.max() < 2:
            break
        level = np.arange(len(size), len(size) + n, dtype=np.int32)
        level[at] = name
        shared = np.zeros(n, bool)
        shared[at] = size[name] > 1
        levels.append(level)
        step *= 2
    return levels


def extend(levels: list[np.ndarray], i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many symbols agree from places i and k > i on, and how many before them; the last symbol is there once."""
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        level, width = levels[j], 1 << j
        # A window that runs past the end has a name of its own, and the last symbol ends every extension.
        ahead += (level[i + ahead] == level[k + ahead]) * width
        a, b = i - back - width, k - back - width
        back += ((level[np.maximum(a, 0)] == level[b]) & (a >= 0)) * width
    return ahead, back


def runs(symbols: np.ndarray, lengths: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of all runs; symbols holds texts of the lengths given, which fall, with a unique symbol around each.

    A stretch that several periods give is a run of the least of them: by Fine and Wilf's theorem that one divides the
    others and is the stretch's smallest period.
    """
    levels = names(symbols)
    ends = np.cumsum(lengths + 1) + 1
    fits = lengths[::-1]
    start, end, period = [], [], []
    held, waiting = 0, []

    def settle() -> None:
        i = np.concatenate([x for x, _ in waiting])
        q = np.concatenate([np.full(len(x), y, np.int64) for x, y in waiting])
        for lo in range(0, len(i), PAIRS):
            a, p = i[lo : lo + PAIRS], q[lo : lo + PAIRS]
            ahead, back = extend(levels, a, a + p)
            good = np.flatnonzero(ahead + back + p >= np.maximum(least, 2 * p))
            s, e, p = (a - back)[good], (a + p + ahead)[good], p[good]
            # Pairs come by ascending period, so the first of a stretch has the least one.
            one = np.sort(np.unique(s * np.int64(len(symbols)) + e, return_index=True)[1])
            start.append(s[one]), end.append(e[one]), period.append(p[one])
        waiting.clear()

    for q in range(1, (int(lengths[0]) if len(lengths) else 0) // 2 + 1):
        texts = len(lengths) - np.searchsorted(fits, max(least, 2 * q))
        if not texts:
            break
        s = symbols[: ends[texts - 1]]
        i = np.flatnonzero(s[:-q:q] == s[q::q]) * q
        if len(i):
            waiting.append((i, q))
            held += len(i)
            if held >= PAIRS:
                settle()
                held = 0
    if waiting:
        settle()
    if not start:
        return (np.zeros(0, np.int64),) * 3
    s, e, p = np.concatenate(start), np.concatenate(end), np.concatenate(period)
    one = np.unique(s * np.int64(len(symbols)) + e, return_index=True)[1]
    return s[one], e[one], p[one]


def search(texts: list[list[bytes]], least: int = 12) -> tuple[list[np.ndarray], list[bytes]]:
    """For each text, given as words: rows (start, length, period) by start and period, and the text without repetitions."""
    import pyarrow as pa

    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    begins = np.cumsum(falling + 1) - falling  # a unique symbol stands before each text and after the last
    words = pa.array([w for t in order for w in texts[t]], pa.binary()).dictionary_encode()
    symbols = np.empty(len(words) + len(texts) + 1, np.int64)
    bounds = np.concatenate([[0], begins + falling]).astype(np.int64)
    inside = np.ones(len(symbols), bool)
    inside[bounds] = False
    symbols[inside] = words.indices.to_numpy()
    symbols[bounds] = len(words.dictionary) + np.arange(len(bounds))
    s, e, p = runs(symbols, falling, least)
    ranked = np.lexsort((p, s))
    s, e, p = s[ranked], e[ranked], p[ranked]
    covered = np.bincount(s + p, minlength=len(symbols) + 1) - np.bincount(e, minlength=len(symbols) + 1)
    kept = np.cumsum(covered) == 0
    cuts = np.searchsorted(s, np.concatenate([begins, [len(symbols)]]))
    found, collapsed = [None] * len(texts), [b""] * len(texts)
    for k, t in enumerate(order):
        at, n, lo, hi = begins[k], falling[k], cuts[k], cuts[k + 1]
        found[t] = np.stack([s[lo:hi] - at, e[lo:hi] - s[lo:hi], p[lo:hi]], axis=1)
        stays = texts[t] if lo == hi else [w for w, x in zip(texts[t], kept[at : at + n].tolist(), strict=True) if x]
        collapsed[t] = b" ".join(stays)
    return found, collapsed


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, *, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of docs (doc_id, text).

    A run is a stretch of consecutive words with smallest period q and max(least, 2q) words or more which no
    neighbouring word extends; runs are sorted by start, then period. collapsed is the words, joined by one space, that
    no run holds after its first q words. One pass, no shuffle: texts are read whole, at most BATCH_WORDS words or
    BATCH_BYTES bytes at once, and a longer text alone, which takes memory for its words and, if it repeats itself throughout, for a name a word
    and level. A null or empty text has no words, no runs and an empty rest. Repeated rows give repeated results and a
    null doc_id stays null. Only doc_id and text are read, so other columns cannot clash; an empty table gives none.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        ids, texts, held, size = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            found, collapsed = search(texts, least)
            flat = np.concatenate(found)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(place)))
            out = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "runs", "collapsed"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_py() or b""
                words = raw.split()
                if texts and (held + len(words) > BATCH_WORDS or size + len(raw) > BATCH_BYTES):
                    yield flush()
                    ids, texts, held, size = [], [], 0, 0
                ids.append(i), texts.append(words)
                held, size = held + len(words), size + len(raw)
        if texts:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, RUNS)
