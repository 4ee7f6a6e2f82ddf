"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks against limits by length."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import SEPARATORS

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / raw size. low and high: (bytes, limit) knots, linear in log2 of the bytes between them.

    Text below low repeats itself, text above high is close to random. Whole texts compress better the longer they
    are, so their limits fall with length; chunks all have one size, so theirs are two numbers. The last chunk ends
    where the text ends and may overlap the one before; a text shorter than a chunk is judged as a whole, by the limits
    of its length. A document fails as a whole, or when more than max_share of its chunks fail. Texts under the first knot's bytes are too short to judge.
    """

    low: tuple[tuple[int, float], ...] = ((64, 0.72), (128, 0.62), (256, 0.57), (512, 0.515), (1024, 0.475), (2048, 0.447), (4096, 0.427), (8192, 0.412), (16384, 0.400), (32768, 0.388), (131072, 0.37))
    high: tuple[tuple[int, float], ...] = ((64, 1.35), (128, 1.08), (256, 0.95), (512, 0.85), (1024, 0.78), (2048, 0.72), (131072, 0.70))
    chunk: int = 2048
    chunk_low: float = 0.40
    chunk_high: float = 0.75
    max_share: float = 0.2
    level: int = 3

    @staticmethod
    def limit(knots: tuple[tuple[int, float], ...], n: int) -> float:
        if n <= knots[0][0]:
            return knots[0][1]
        for (a, x), (b, y) in zip(knots, knots[1:], strict=False):
            if n <= b:
                return x + (y - x) * math.log(n / a) / math.log(b / a)
        return knots[-1][1]


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that stand in a window of so many words that the text has twice or more, the first included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen, covered, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def measure(text: str | None, bands: Bands, compressor) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, n_chunks, bad_chunks, reason."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    repeat = repeated_words(words)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    ratio = len(compressor.compress(raw)) / len(raw) if raw else None
    chunks = bad = 0
    starts = [*range(0, len(raw) - bands.chunk + 1, bands.chunk)]
    if starts and len(raw) % bands.chunk:
        starts.append(len(raw) - bands.chunk)
    for at in starts:
        part = raw[at : at + bands.chunk]
        chunks += 1
        r = len(compressor.compress(part)) / len(part)
        bad += r < bands.chunk_low or r > bands.chunk_high
    reason = None
    if failed:
        reason = "base"
    elif len(raw) >= bands.low[0][0] and ratio < bands.limit(bands.low, len(raw)):
        reason = "repetitive"
    elif len(raw) >= bands.high[0][0] and ratio > bands.limit(bands.high, len(raw)):
        reason = "incompressible"
    elif bad > bands.max_share * chunks:
        reason = "chunks"
    return len(words), len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, ratio, chunks, bad, reason


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, bad_chunks long, reason string, kept boolean"


def assess(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """doc_id and the measures of every whole text, with kept and the reason of a rejection.

    A null text counts as empty: no words, base_failed, ratio null. Repeated rows give repeated results, a null doc_id
    stays null. Only doc_id and text are read, so other columns cannot clash.
    """
    bands = bands or Bands()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        names = ["doc_id", *(x.split()[0] for x in MEASURES.split(", "))]
        types = [pa.int64(), *[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for b in batches:
            rows = [(*m, m[-1] is None) for m in (measure(t, bands, compressor) for t in b.column(1).to_pylist())]
            cols = [*zip(*rows, strict=True)] if rows else [()] * len(types[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {MEASURES}")


def keep_good(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """The rows of docs whose text assess() keeps, all columns as they are; one pass, no shuffle."""
    bands = bands or Bands()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([measure(t, bands, compressor)[-1] is None for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
