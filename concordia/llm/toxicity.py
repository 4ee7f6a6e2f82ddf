"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, weighted votes.

Labelled rows up to a documented bound are the examples. Terms are all their lower-cased words without outer
punctuation that two examples or more have, weighted by plain TF-IDF. Examples lie in blocks of similar ones; the index
has, for each term, the postings by block and the largest weight in each block that has the term. The k nearest of a
text are found exactly: blocks are scored in the order of their upper bounds, in growing waves, and blocks whose bound
does not reach the k-th best cosine so far are never read. The neighbours vote term by term: those that share a term
with the text vote on it with their cosines; a term's vote is by how many standard deviations its voters depart from the
share of label 1 among all examples, and the text's vote is the sum of its highest ones. A monotone map that is fitted on the examples' own votes,
each without itself, turns votes into probabilities; labels enter nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import discard, materialize

PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&…«»“”"
#: The score where labels tell nothing: none are given, or all are the same.
BASE_RATE = 0.1
#: Texts whose frequent terms are multiplied together.
BATCH = 64
#: Nearest examples that are returned as evidence.
EVIDENCE = 3


@dataclass(frozen=True)
class Settings:
    #: The most labelled rows that are used as examples; beyond it the rows of least hash are taken.
    max_examples: int = 3_000
    k: int = 300
    #: Added to the variance of a term's votes, so that a few voters tell little; terms whose votes are added up.
    smoothing: float = 0.5
    terms: int = 3
    block: int = 64
    #: Blocks of the first wave besides those that k examples fill; those that it does not rule out are read together.
    wave: int = 4
    #: The most frequent terms, whose postings are kept as whole rows and multiplied for many texts at once.
    dense: int = 256


class Terms(dict):
    """Word to what it is as a term (its number in known, where that is given), or None; kept for at most bound words."""

    def __init__(self, known: dict[str, int] | None = None, bound: int = 400_000):
        self.known, self.bound = known, bound

    def __missing__(self, word: str):
        out = word.strip(PUNCTUATION) or None
        if self.known is not None:
            out = self.known.get(out)
        if len(self) >= self.bound:
            self.clear()
        self[word] = out
        return out

    def counts(self, text: str | None) -> dict:
        out: dict = {}
        for word, n in Counter((text or "").lower().split()).items():
            term = self[word]
            if term is not None:
                out[term] = out.get(term, 0) + n
        return out


@dataclass
class Model:
    """Examples in blocks, the inverted index, and the map from votes to probabilities."""

    settings: Settings
    vocabulary: dict[str, int]
    #: Inverse document frequency.
    weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    #: Weights of the most frequent terms (rows) in all examples, and where they have the term.
    rows: np.ndarray
    has: np.ndarray
    #: Postings of the others by term and example: the examples and their weights; where each term's begin.
    example: np.ndarray
    value: np.ndarray
    begin: np.ndarray
    #: For each term and block that has it: the block, where its postings begin, the largest weight; where each term's begin.
    part: np.ndarray
    first: np.ndarray
    most: np.ndarray
    parts: np.ndarray
    blocks: int
    prior: float
    empty: float
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        return _vector(counts, self.weight)

    def frequent(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The part of the cosines that the most frequent terms make, a row for each vector."""
        q = np.zeros((len(vectors), len(self.rows)))
        for row, (t, w) in zip(q, vectors, strict=True):
            n = np.searchsorted(t, len(self.rows))
            row[t[:n]] = w[:n]
        return q @ self.rows

    def _entries(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (term, block) entries of the terms t, and how many each term has."""
        n = self.parts[t + 1] - self.parts[t]
        return _ranges(self.parts[t], n), n

    def nearest(self, t: np.ndarray, w: np.ndarray, skip: int = -1, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """The k examples of largest cosine above 0 (ties: the smaller index), their cosines, and the number of blocks read.

        part is frequent() of the vector, where it is known.
        """
        k, size = self.settings.k, self.settings.block
        if not len(t) or not len(self.ids):
            return np.zeros(0, int), np.zeros(0), 0
        part = self.frequent([(t, w)])[0] if part is None else part
        n = np.searchsorted(t, len(self.rows))
        entries, many = self._entries(t[n:] - len(self.rows))
        weight, block = np.repeat(w[n:], many), self.part[entries]
        bound = np.maximum.reduceat(part, np.arange(0, len(part), size)) + np.bincount(block, weights=weight * self.most[entries], minlength=self.blocks) + 1e-9
        order = np.argsort(-bound, kind="stable")
        score, read, least, wave = np.zeros(len(self.ids)), 0, 0.0, self.settings.wave + k // size
        for chosen in (order[:wave], order[wave:]):
            chosen = chosen[bound[chosen] >= least]
            if not len(chosen):
                break
            inside = np.zeros(len(bound), bool)
            inside[chosen] = True
            score += np.where(np.repeat(inside, size)[: len(part)], part, 0)
            own = entries[inside[block]]
            length = self.first[own + 1] - self.first[own]
            at = _ranges(self.first[own], length)
            score += np.bincount(self.example[at], weights=self.value[at] * np.repeat(weight[inside[block]], length), minlength=len(score))
            read += len(chosen)
            if skip >= 0:
                score[skip] = 0
            if len(score) > k:
                least = float(np.partition(score, -k)[-k])
        own = np.flatnonzero((score > 1e-12) & (score >= least))
        top = own[np.lexsort((own, -score[own]))[:k]]
        return top, score[top], read

    def vote(self, i: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[float, int]:
        """The vote of the neighbours i with cosines c for a text of the terms t, and the term with the highest vote.

        Of a term's voters, the sum of cosines (the nearest counts 1) with label 1 is held against its expectation.
        """
        cosine, toxic = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        cosine[i] = c / c[0]
        toxic[i] = cosine[i] * self.labels[i]
        n = np.searchsorted(t, len(self.rows))
        has = self.has[np.ix_(t[:n], i)]
        rare = t[n:] - len(self.rows)
        many = self.begin[rare + 1] - self.begin[rare]
        who, of = self.example[_ranges(self.begin[rare], many)], np.repeat(np.arange(len(rare)), many)
        voters = cosine[who] > 0
        who, of = who[voters], of[voters]
        under = lambda x: np.bincount(of, weights=x[who], minlength=len(rare))
        every, ones = np.concatenate([has @ cosine[i], under(cosine)]), np.concatenate([has @ toxic[i], under(toxic)])
        z = (ones - every * self.prior) / np.sqrt(every * self.prior * (1 - self.prior) + self.settings.smoothing)
        return float(np.sort(z)[-self.settings.terms :].sum()), int(t[np.round(z, 9).argmax()])

    def judge(self, i: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[float, int]:
        """The calibrated score and the term that tells most; a text without a neighbour has the score empty and no term."""
        if not len(i):
            return self.empty, -1
        vote, term = self.vote(i, c, t)
        return float(np.interp(vote, *self.knots)), term


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers, then those of first[1], and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _vector(counts: dict[int, int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order and their weights, of length 1."""
    t = np.fromiter(counts, np.int64, len(counts))
    w = (1 + np.log(np.fromiter(counts.values(), float, len(counts)))) * weight[t]
    order = np.argsort(t)
    return t[order], w[order] / np.sqrt((w * w).sum()) if len(w) else w


def fit(rows: list[tuple[int, int, dict[int, int]]], vocabulary: dict[str, int], settings: Settings) -> Model:
    """rows: example id, label, counts of terms by their numbers in vocabulary, the more frequent first.

    Without both labels a model has no examples and scores every text BASE_RATE. A text without a neighbour has the
    share of label 1 among such examples, and is never predicted 1.
    """
    ones = sum(r[1] for r in rows)
    rows = [] if ones in (0, len(rows)) else rows
    n, size, v = len(rows), settings.block, len(vocabulary)
    have = np.zeros(v)
    for _, _, c in rows:
        have[list(c)] += 1
    weight = np.log((1 + n) / (1 + have)) + 1
    prior = float((ones + BASE_RATE) / (n + 1)) if n else BASE_RATE
    bare = [r[1] for r in rows if not r[2]]
    empty = min((sum(bare) + prior) / (len(bare) + 1), 0.49)
    # Similar examples share blocks: they are sorted by the term of most weight.
    vectors = [_vector(r[2], weight) for r in rows]
    order = sorted(range(n), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, rows[i][0]))
    vectors = [vectors[i] for i in order]
    lengths = [len(t) for t, _ in vectors]
    term, value = (np.concatenate(x) if n else np.zeros(0, d) for x, d in (([t for t, _ in vectors], np.int64), ([w for _, w in vectors], float)))
    example = np.repeat(np.arange(n), lengths)
    by = np.lexsort((example, term))
    term, value, example = term[by], value[by], example[by]
    blocks, often = -(-n // size), min(settings.dense, v)
    dense = np.zeros((often, n))
    dense[term[term < often], example[term < often]] = value[term < often]
    rare = term >= often
    term, value, example = term[rare] - often, value[rare], example[rare]
    v -= often
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (example[1:] // size != example[:-1] // size)
    first = np.flatnonzero(new)
    most = np.maximum.reduceat(value, first) if len(first) else value
    edges = np.arange(v + 1)
    labels = np.array([rows[i][1] for i in order], float)
    model = Model(settings, vocabulary, weight, np.array([rows[i][0] for i in order], np.int64), labels, dense, (dense > 0).astype(float), example.astype(np.int32), value, np.searchsorted(term, edges), example[first] // size, np.append(first, len(term)), most, np.searchsorted(term[first], edges), blocks, prior, empty)
    votes = []
    for at in range(0, n, BATCH):
        own = vectors[at : at + BATCH]
        for i, (vector, part) in enumerate(zip(own, model.frequent(own), strict=True), at):
            near, c, _ = model.nearest(*vector, skip=i, part=part)
            if len(near):
                votes.append((model.vote(near, c, vector[0])[0], labels[i]))
    model.knots = monotone(votes, prior)
    return model


def monotone(votes: list[tuple[float, float]], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over votes in bins of at least 20; knots for interpolation, each drawn to prior a little."""
    if not votes:
        return np.zeros(1), np.full(1, prior)
    votes = sorted(votes)
    pools: list[list[float]] = []  # sum of votes, of labels, number
    for at in range(0, len(votes), 20):
        part = votes[at : at + 20]
        pools.append([sum(x for x, _ in part), sum(y for _, y in part), len(part)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], a, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + prior) / (p[2] + 1) for p in pools])


def examples(docs: DataFrame, labels: DataFrame, settings: Settings, *, target: str = "toxic", fold: int = 5) -> DataFrame:
    """id, label, text of the labelled rows to learn from: crc32(doc_id as text) mod fold is not 0, bounded by settings.

    Of several labels for one id the largest counts; null ids and labels are ignored. Of several texts of one id the
    greatest is taken, so repeated rows don't multiply examples.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(target).cast("int").alias("label")).where("__id is not null and label is not null").groupBy("__id").agg(F.max("label").alias("label"))
    own = own.where(F.crc32(F.col("__id").cast("string").cast("binary")) % fold != 0)
    own = own.orderBy(F.xxhash64("__id", F.lit(11)), "__id").limit(settings.max_examples)
    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = read.join(F.broadcast(own), F.col("id") == F.col("__id"))
    return found.groupBy("id", "label").agg(F.max("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, **how) -> Model:
    """Build the index from the bounded examples: the driver gets their terms and counts, max_examples rows.

    Every term of two examples or more counts. A text of any length is counted whole.
    """
    settings = settings or Settings()
    chosen = materialize(examples(docs, labels, settings, **how), "examples")

    def presence(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Terms()
        for b in batches:
            for text in b.column(2).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(list(words.counts(text)), pa.string())], ["term"])

    found = chosen.mapInArrow(presence, "term string").groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    top = found.orderBy(F.desc("n"), "term").select("term").toPandas()["term"]
    vocabulary = {t: i for i, t in enumerate(top)}

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Terms(vocabulary)
        for b in batches:
            counts = [words.counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(c) for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["id", "label", "terms", "counts"])

    rows = chosen.mapInArrow(vectors, "id long, label int, terms array<int>, counts array<int>").collect()
    discard(chosen)
    return fit([(int(i), int(y > 0), dict(zip(t, c, strict=True))) for i, y, t, c in rows], vocabulary, settings)


class Scorer:
    """Scores of texts by a model; equal texts are looked up once (at most bound of them are kept)."""

    def __init__(self, model: Model, bound: int = 50_000):
        self.model, self.words, self.memo, self.bound = model, Terms(model.vocabulary), {}, bound
        self.names = list(model.vocabulary)

    def __call__(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray, str | None]:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray, str | None]]:
        """The score, the nearest examples, their cosines and the telling term of each text."""
        from xxhash import xxh3_128_digest

        m, out = self.model, []
        for first in range(0, len(texts), BATCH):
            part = texts[first : first + BATCH]
            keys = [xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in part]
            if len(self.memo) >= self.bound:
                self.memo.clear()
            new = {k: t for k, t in zip(keys, part, strict=True) if k not in self.memo}
            vectors = [m.vector(self.words.counts(t)) for t in new.values()]
            for k, vector, known in zip(new, vectors, m.frequent(vectors), strict=True):
                i, c, _ = m.nearest(*vector, part=known)
                p, term = m.judge(i, c, vector[0])
                # A copy of the nearest few: the memo would keep all k alive.
                self.memo[k] = min(1.0, max(0.0, p)), i[:EVIDENCE].copy(), c[:EVIDENCE].copy(), self.names[term] if term >= 0 else None
            out += [self.memo[k] for k in keys]
        return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, neighbours (ids of the nearest examples), their cosines and the telling term of every whole text.

    The model is broadcast; max_examples bounds the rows that it is made of. A null or empty text, or one without a known term,
    gets the share of label 1 among such examples and is never predicted 1; a model of one label or none scores every
    text BASE_RATE. Of equally near examples those of lesser place in the index come first.
    Repeated rows and null ids give a row each; texts of any length are read whole. Nothing but text enters a score,
    and only doc_id and text are read, so other columns cannot clash. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        scorer = Scorer(m)
        for b in batches:
            scores, ids, cosines, terms = [], [], [], []
            for p, i, c, term in scorer.many(b.column(1).to_pylist()):
                scores.append(p)
                ids.append(m.ids[i].tolist())
                cosines.append(c.tolist())
                terms.append(term)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64())), pa.array(terms, pa.string())], ["doc_id", "score", "predicted", "neighbours", "cosines", "term"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, neighbours array<long>, cosines array<double>, term string")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't predict toxic, all columns as they are; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([p < 0.5 for p, *_ in scorer.many(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
