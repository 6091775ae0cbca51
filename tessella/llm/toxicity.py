"""Toxicity by weak supervision: many lexicon and pattern voters, a generative model of their votes,
and a linear classifier trained on the model's posterior labels.

1. Lexicons: a short fixed list of insults, and words and word beginnings that labelled rows show to
   be at least twelve times as frequent in toxic texts. Learning takes at most `most_labelled` labelled
   rows (those with the smallest hash of doc_id), never rows of the held-out fifth.
2. Voters: the lexicons, dealt to several voters, and two patterns. Every document gets its votes.
3. Label model: over the table of vote patterns (at most 2**voters rows for any corpus),
   expectation-maximisation fits, for toxic and for clean texts, how readily each voter fires and how
   strongly each pair of voters fires together (a log-linear model with pairwise terms, normalised over all
   patterns). Labelled rows give the start and hold the two classes apart with a tenth of the corpus' weight.
4. Classifier: logistic regression with an L1 penalty on hashed words and word beginnings of the labelled
   rows and of at most `most_unlabelled` others, with the model's posterior as target. A row's own label
   is not looked at there, so a wrong label does not force its target.

Edges: null and empty texts get the score of a text without any known word; labels that are null are
left out, of conflicting labels of one doc_id the larger counts, and of several texts of one labelled
doc_id the one with the smallest hash; without labels of both kinds the fixed list alone starts the model;
an empty table gives an empty result; a null doc_id is not held out and not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialise

WORD = re.compile(r"[^\W\d_]+")
#: Plain insults that need no labels (fixed values).
SEED = ("idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "fool", "dumb", "imbecile", "vermin", "filth", "jerk", "creep", "bastard", "damn", "hate")
BUCKETS = 1 << 17
WORD_VOTERS, STEM_VOTERS = 4, 3
VOTERS = 1 + WORD_VOTERS + STEM_VOTERS + 2


def terms(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four and five letters, marked with a star."""
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n))


def words_in(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Voters:
    """term -> voter number; the last two voters are patterns over all terms found."""

    of: dict[str, int] = field(default_factory=dict)
    known: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def build(found: list[str]) -> Voters:
        of = dict.fromkeys(SEED, 0)
        for t in found:
            if t not in of:
                h = xxhash.xxh64_intdigest(t)
                of[t] = 1 + WORD_VOTERS + h % STEM_VOTERS if t.endswith("*") else 1 + h % WORD_VOTERS
        return Voters(of)

    def _word(self, word: str) -> int:
        mask = 0
        for t in terms(word):
            if (v := self.of.get(t)) is not None:
                mask |= 1 << v
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[word] = mask
        return mask

    def mask(self, words: set[str]) -> int:
        known, hits, mask = self.known, 0, 0
        for w in words:
            m = known.get(w)
            if m is None:
                m = self._word(w)
            if m:
                hits, mask = hits + 1, mask | m
        if hits >= 2:
            mask |= 1 << (VOTERS - 2)
        if hits * 50 >= len(words) > 0:
            mask |= 1 << (VOTERS - 1)
        return mask


BITS = ((np.arange(1 << VOTERS)[:, None] >> np.arange(VOTERS)) & 1).astype(float)
FIRST, SECOND = np.triu_indices(VOTERS, 1)
#: A row for each vote pattern: the votes, and the pairs that vote together.
FEATURES = np.hstack([BITS, BITS[:, FIRST] * BITS[:, SECOND]])


@dataclass
class LabelModel:
    """P(toxic), and for clean and toxic texts the weights of votes and of pairs of votes."""

    prior: float
    weights: np.ndarray  # (2, voters + pairs)

    def log_patterns(self) -> np.ndarray:
        """log P(pattern | class), (2, patterns)."""
        energy = self.weights @ FEATURES.T
        return energy - np.logaddexp.reduce(energy, axis=1, keepdims=True)

    def log_odds(self, masks: np.ndarray) -> np.ndarray:
        each = self.log_patterns()
        return np.log(self.prior / (1 - self.prior)) + (each[1] - each[0])[masks]


def fit_pairs(mass: np.ndarray, start: np.ndarray, steps: int = 6, hold: float = 2.0) -> np.ndarray:
    """Weights under which the model's means of votes and pairs are those of the weighted patterns (Newton's method,
    `hold` draws the weights of pairs to zero)."""
    w, share = start.copy(), mass / mass.sum()
    held = np.where(np.arange(len(w)) < VOTERS, 1e-3, hold) / mass.sum()
    for _ in range(steps):
        energy = FEATURES @ w
        p = np.exp(energy - np.logaddexp.reduce(energy))
        mean = p @ FEATURES
        cov = (FEATURES * p[:, None]).T @ FEATURES - np.outer(mean, mean)
        step = np.linalg.solve(cov + np.diag(held + 1e-6), share @ FEATURES - mean - held * w)
        w = np.clip(w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max())), -12, 12)
    return w


def fit_label_model(counts: np.ndarray, prior: float, fires: np.ndarray, known: np.ndarray | None = None, rounds: int = 15, share: float = 0.1) -> LabelModel:
    """EM over vote patterns; counts: documents with each pattern. known (2, patterns): labelled rows, which weigh
    `share` of the corpus in their class; without them `fires`, the chance of each voter to fire, does."""
    start = np.hstack([np.log(fires / (1 - fires)), np.zeros((2, len(FIRST)))])
    model = LabelModel(prior, start)
    anchor = np.exp(model.log_patterns()) if known is None else (known + 5 * np.exp(model.log_patterns())) / (known.sum(1, keepdims=True) + 5)
    anchor = anchor * share * counts.sum() * np.array([[1 - prior], [prior]]) + 5 * np.exp(model.log_patterns())
    model = LabelModel(prior, np.stack([fit_pairs(anchor[k], start[k], 20) for k in (0, 1)]))
    every = np.arange(len(counts))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(model.log_odds(every), -30, 30)))
        mass = np.array([counts * (1 - p), counts * p]) + anchor
        new = float(np.clip(mass[1].sum() / mass.sum(), 0.002, 0.5))
        model = LabelModel(new, np.stack([fit_pairs(mass[k], model.weights[k]) for k in (0, 1)]))
    return model


def fit_linear(rows: list[np.ndarray], target: np.ndarray, epochs: int = 15, parts: int = 16, rate: float = 0.15, penalty: float = 3e-4, toxic_weight: float = 3.0) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed counts by proximal AdaGrad, a step for each of `parts` parts of the rows; the L1
    penalty leaves most weights at zero.

    Rows that are likely toxic weigh `toxic_weight` times, as they are few.
    """
    w, b, g2, gb = np.zeros(BUCKETS), -2.0, np.full(BUCKETS, 1e-4), 1e-8
    cut = []
    for k in range(parts):
        own = rows[k::parts]
        if own:
            at, of = np.concatenate(own), np.repeat(np.arange(len(own)), [len(r) for r in own])
            cut.append((at, of, target[k::parts], np.where(target[k::parts] > 0.5, toxic_weight, 1.0) / len(own)))
    for _ in range(epochs):
        for at, of, goal, scale in cut:
            z = b + np.bincount(of, w[at], len(goal))
            d = scale * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal)
            grad = np.bincount(at, d[of], BUCKETS)
            g2 += grad * grad
            step = rate / np.sqrt(g2)
            w = w - step * grad
            w = np.sign(w) * np.maximum(0, np.abs(w) - step * penalty)
            gb += d.sum() ** 2
            b -= rate * d.sum() / np.sqrt(gb)
    return w, float(b)


def buckets(words: set[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) & (BUCKETS - 1) for w in words for t in terms(w)), np.int64)


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    weights: np.ndarray
    bias: float


def _held(ident: str):
    return F.col(ident).isNotNull() & (F.crc32(F.col(ident).cast("string").cast("binary")) % 5 == 0)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", most_labelled: int = 12_000, most_unlabelled: int = 8_000) -> Model:
    body = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    own = labels.where(F.col(ident).isNotNull() & F.col("toxic").isNotNull() & ~_held(ident)).groupBy(F.col(ident).alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    first = lambda ids, n: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = materialise(first(own, most_labelled), "sample")
    others = body.select("doc_id").where(F.col("doc_id").isNotNull() & ~_held("doc_id")).join(F.broadcast(sample), "doc_id", "left_anti")
    chosen = materialise(sample.unionByName(first(others, most_unlabelled).distinct().withColumn("toxic", F.lit(None).cast("int"))), "chosen")
    drawn = body.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    drawn = materialise(drawn.select("doc_id", "toxic", "t.text"), "drawn")  # most_labelled + most_unlabelled rows
    rows = drawn.where("toxic is not null")

    def split(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, toxic in batches(frames, "text", "toxic"):
            found = [sorted({t for w in words_in(x) for t in terms(w)}) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(found, pa.list_(pa.string()))], names=["toxic", "terms"])

    totals = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_toxic, n_all = int(totals[0]), int(totals[1])
    lexicon: list[str] = []
    if 0 < n_toxic < n_all:
        each = rows.select("text", "toxic").mapInArrow(split, "toxic int, terms array<string>")
        lift = ((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("c") + 0.5) / (n_all - n_toxic + 1))
        seen = each.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        lexicon = [r["term"] for r in seen.where(F.col("t") >= 4).where(lift >= 12).select("term").collect()]  # of a bounded sample
    voters = Voters.build(lexicon)
    counts, known = np.zeros(1 << VOTERS), np.zeros((2, 1 << VOTERS))
    for r in cast_votes(body, voters, "text", ["doc_id"]).groupBy("votes").count().collect():  # 2**voters rows at most
        counts[r["votes"]] = r["count"]
    for r in cast_votes(rows, voters, "text", ["toxic"]).groupBy("votes", "toxic").count().collect():
        known[r["toxic"], r["votes"]] = r["count"]
    both = known.sum(1).min() > 0
    fires = np.full((2, VOTERS), [[0.005], [0.4]])
    if both:
        fires = (known @ BITS + 5 * fires) / (known.sum(1, keepdims=True) + 5)
    model = fit_label_model(counts, known[1].sum() / known.sum() if both else 0.05, np.clip(fires, 1e-4, 1 - 1e-4), known if both else None)

    def features(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches(frames, "text"):
            words = [words_in(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([buckets(w).astype("<i4").tobytes() for w in words], pa.binary()), pa.array([voters.mask(w) for w in words], pa.int64())], names=["at", "votes"])

    at, votes = [], []
    for r in materialise(drawn.select("text").mapInArrow(features, "at binary, votes long"), "features").toLocalIterator():  # the bounded sample
        at.append(np.frombuffer(r["at"], "<i4"))
        votes.append(r["votes"])
    weights, bias = fit_linear(at, targets(model, np.array(votes, np.int64)))
    return Model(voters, model, weights, bias)


def targets(model: LabelModel, votes: np.ndarray) -> np.ndarray:
    """Posterior of toxic, from the votes alone."""
    return 1 / (1 + np.exp(-np.clip(model.log_odds(votes), -30, 30)))


def cast_votes(docs: DataFrame, voters: Voters, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and votes, a bit for each voter that fires."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(voters.of)
        for batch, texts in batches(frames, text):
            votes = pa.array([own.mask(words_in(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), votes], names=[*keep, "votes"])

    frame = docs.select(*keep, text)
    return frame.mapInArrow(run, frame.select(*keep).schema.add("votes", "long"))


def score(docs: DataFrame, model: Model, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, score: the classifier's probability of toxic, from the whole text."""
    nonzero = np.flatnonzero(model.weights)
    sparse, bias = dict(zip(nonzero.tolist(), model.weights[nonzero].tolist(), strict=True)), model.bias

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch, texts in batches(frames, text):
            out = []
            for t in texts:
                z = bias
                for w in words_in(t):
                    v = known.get(w)
                    if v is None:
                        if len(known) > 400_000:
                            known.clear()
                        v = known[w] = sum(sparse.get(xxhash.xxh64_intdigest(x) & (BUCKETS - 1), 0.0) for x in terms(w))
                    z += v
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(ident, text).mapInArrow(run, f"doc_id {docs.schema[ident].dataType.simpleString()}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = score(docs, model)
    return out.select("doc_id", _held("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
