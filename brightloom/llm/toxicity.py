"""Toxicity by class-conditional Kneser-Ney models (operator 10).

Two character models of order five over the words of a text, one of toxic and one of ordinary texts. Each has its own
counts at the highest order; what it discounts goes to lower orders whose continuation counts both share, so that an
expression too rare to tell the classes apart weighs the same in both. A text is judged by the difference of its
log-likelihoods per word and by those of its most telling words, which a long text does not drown; a logistic
function, fitted on counts that leave out the judged half of the labelled texts, turns them into a score.

Learning takes at most ``most_toxic`` and ``most_ordinary`` labelled texts, whole, those with the least hashes of
their ids; so the model that is broadcast has a bounded size. Scoring reads every whole text once and shuffles
nothing. Label, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import release
from .workspace import ARROW_ROWS, Workspace, least_hashes

ORDER, DISCOUNT, MOST_TOXIC, MOST_ORDINARY, CUT = 5, 0.75, 8_000, 16_000, 0.3
_BEGIN, _END = "\x02" * (ORDER - 1), "\x03"


def words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def gram_codes(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The character n-grams of words with their borders, as rows of code points, and where each word's begin."""
    lens = np.array([len(w) for w in own], dtype=np.int64)
    flat = np.frombuffer("".join([_BEGIN + w + _END for w in own]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum(lens + 1)])
    at = np.arange(starts[-1]) + np.repeat(np.arange(len(own)) * (ORDER - 1), lens + 1)
    return np.lib.stride_tricks.sliding_window_view(flat, ORDER)[at] if len(own) else np.zeros((0, ORDER), np.uint32), starts


def keys_of(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of code points."""
    out = np.zeros(len(codes), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[:, j].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


def shared_chances(codes: np.ndarray) -> np.ndarray:
    """P(last character | the ORDER - 2 before it) of each distinct n-gram, by interpolated Kneser-Ney on counts of
    distinct continuations, which both classes share: from single characters up."""
    levels = []
    rows = np.arange(len(codes))  # a representative of each type of the level above
    for m in range(ORDER - 1, 0, -1):
        _, first, inverse, count = np.unique(keys_of(codes[rows, ORDER - m :]), return_index=True, return_inverse=True, return_counts=True)
        levels.append((rows[first], inverse, count))
        rows = rows[first]
    below = np.full(len(levels[-1][0]), 1 / (len(levels[-1][0]) + 1))
    for k in range(len(levels) - 1, -1, -1):
        own, _, count = levels[k]
        m = ORDER - 1 - k
        _, context = np.unique(keys_of(codes[own, ORDER - m : ORDER - 1]), return_inverse=True)
        total, kinds = np.bincount(context, weights=count), np.bincount(context)
        chance = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds[context] * below) / total[context]
        below = chance[levels[k][1]]  # of each type one level up
    return below


@dataclass
class Model:
    """log P_toxic - log P_ordinary of each n-gram seen, and of any other after a context seen, by sorted keys."""

    gram: np.ndarray
    gram_value: np.ndarray
    context: np.ndarray
    context_value: np.ndarray
    weights: list[float] = field(default_factory=lambda: [0.0] * 4)

    def words(self, own: list[str]) -> np.ndarray:
        """The differences of whole words."""
        codes, starts = gram_codes(own)
        if not len(own) or not len(self.gram):
            return np.zeros(len(own))
        key = keys_of(codes)
        at = np.minimum(np.searchsorted(self.gram, key), len(self.gram) - 1)
        value, hit = self.gram_value[at].astype(float), self.gram[at] == key
        if not hit.all():
            key = keys_of(codes[~hit, : ORDER - 1])
            at = np.minimum(np.searchsorted(self.context, key), len(self.context) - 1)
            value[~hit] = np.where(self.context[at] == key, self.context_value[at], 0.0)
        return np.add.reduceat(value, starts[:-1])

    def features(self, values: np.ndarray) -> tuple[float, float, float]:
        """The mean over the words, the largest, and the mean of the largest three."""
        if not len(values):
            return 0.0, 0.0, 0.0
        top = np.partition(values, -3)[-3:] if len(values) > 3 else values
        return float(values.mean()), float(top.max()), float(np.maximum(top, 0).sum() / 3)

    def score(self, features: tuple[float, float, float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features, strict=True))
        return 1 / (1 + exp(-max(-60.0, min(60.0, z))))


class Judge:
    """Features of texts, with a bounded memory of words."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most, self.known = model, most, {}

    def features(self, texts: list[str | None]) -> list[tuple[float, float, float]]:
        out: list[tuple[float, float, float]] = []
        for at in range(0, len(texts), 200):
            split = [words(t) for t in texts[at : at + 200]]
            if len(self.known) > self.most:
                self.known.clear()
            new = [w for w in set(chain.from_iterable(split)) if w not in self.known]
            self.known.update(zip(new, self.model.words(new).tolist(), strict=True))
            get = self.known.__getitem__
            out += [self.model.features(np.fromiter(map(get, own), dtype=float, count=len(own))) for own in split]
        return out


def fit_counts(codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, shared: np.ndarray) -> Model:
    """The model of two columns of n-gram counts; ``shared`` has the lower orders' chances."""
    context, inverse = np.unique(keys_of(codes[:, : ORDER - 1]), return_inverse=True)
    logs, left = [], []
    for count in (toxic, ordinary):
        total, kinds = np.bincount(inverse, weights=count, minlength=len(context)), np.bincount(inverse, weights=count > 0, minlength=len(context))
        rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        left.append(rest)
        logs.append(np.log(np.maximum(count - DISCOUNT, 0) / np.maximum(total[inverse], 1) + rest[inverse] * shared))
    key = keys_of(codes)
    order = np.argsort(key)
    return Model(key[order], (logs[0] - logs[1])[order].astype(np.float32), context, np.log(left[0] / left[1]).astype(np.float32))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> list[float]:
    """Weights of a logistic regression with intercept, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class and half, text) -> (gram, four counts)."""
    def told(tables: list[Counter]) -> pa.RecordBatch:
        codes = [gram_codes(list(t)) for t in tables]
        part = np.repeat(np.arange(4), [len(c) for c, _ in codes])
        weight = np.concatenate([np.repeat(np.fromiter(t.values(), dtype=np.int64, count=len(t)), np.diff(starts)) for t, (_, starts) in zip(tables, codes, strict=True)])
        codes = np.concatenate([c for c, _ in codes])
        _, first, inverse = np.unique(keys_of(codes), return_index=True, return_inverse=True)
        text = np.ascontiguousarray(codes[first]).tobytes().decode("utf-32-le", "surrogatepass")
        counts = [np.bincount(inverse[part == k], weights=weight[part == k], minlength=len(first)).astype(np.int64) for k in range(4)]
        return pa.RecordBatch.from_arrays([pa.array([text[k : k + ORDER] for k in range(0, len(text), ORDER)], pa.string()), *map(pa.array, counts)], ["gram", "c0", "c1", "c2", "c3"])

    tables = [Counter() for _ in range(4)]
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tables[k].update(words(text))
            if sum(map(len, tables)) > 80_000:
                yield told(tables)
                tables = [Counter() for _ in range(4)]
    yield told(tables)


def _codes_of(grams: pa.StringArray) -> np.ndarray:
    """The code points of n-grams, a row each, without a Python string for each."""
    ends = np.frombuffer(grams.buffers()[1], dtype=np.int32)[grams.offset : grams.offset + len(grams) + 1]
    text = bytes(grams.buffers()[2][ends[0] : ends[-1]]).decode() if len(grams) else ""
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(-1, ORDER)


def learn(work: Workspace, docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY) -> Model:
    """Fit on labelled texts: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic). An id with several labels is toxic
    if one says so; labels other than 0 and 1 do not count."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = []
    for toxic, most in ((1, most_toxic), (0, most_ordinary)):
        drawn = least_hashes(given.filter(F.col("toxic") == toxic), F.col("doc_id"), most, sizes.get(toxic, 0))
        picked += [(r["doc_id"], toxic) for r in drawn.collect()]
    chosen = work.spark.createDataFrame(picked, "doc_id long, toxic int")  # at most most_toxic + most_ordinary rows
    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = work.save(texts.join(F.broadcast(chosen), "doc_id").select((F.col("toxic") * 2 + half).alias("part"), "text"), "sample")
    counted = sample.mapInArrow(_counter, "gram string, c0 long, c1 long, c2 long, c3 long").groupBy("gram").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(4)))
    table = counted.toArrow()  # n-grams of the bounded sample
    codes = np.concatenate([_codes_of(c) for c in table.column(0).chunks] or [np.zeros((0, ORDER), np.uint32)])
    parts = [table.column(k + 1).to_numpy().astype(float) for k in range(4)]
    del table
    order = np.argsort(keys_of(codes))
    codes, parts = codes[order], [p[order] for p in parts]
    shared = shared_chances(codes)
    halves = work.broadcast([fit_counts(codes, parts[2 + k], parts[k], shared) for k in range(2)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features of each labelled text by the model of the other half."""
        judges = [Judge(m, 50_000) for m in halves.value]
        for batch in batches:
            part = batch.column(0).to_numpy()
            for half in (0, 1):
                own = batch.filter(pa.array(part % 2 == half))
                rows = judges[1 - half].features(own.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(3))], ["part", "a", "b", "c"])
        judges.clear()
        release()

    judged = sample.mapInArrow(judge, "part int, a double, b double, c double").toArrow()
    seen = np.column_stack([c.to_numpy().astype(float) for c in judged.columns])
    seen = seen[np.lexsort(seen.T)]
    model = fit_counts(codes, parts[2] + parts[3], parts[0] + parts[1], shared)
    work.forget(halves)
    toxic = seen[:, 0] >= 2
    if 0 < toxic.sum() < len(seen):
        weight = np.where(toxic, sizes[1] / toxic.sum(), sizes[0] / (~toxic).sum())
        model.weights = logistic(seen[:, 1:], toxic.astype(float), weight)
    else:  # one class only: its share says all
        model.weights = [30.0 if toxic.any() else -30.0, 0.0, 0.0, 0.0]
    work.drop("sample")
    del codes, parts, shared, judged, seen
    release()
    return model


def scores(docs: DataFrame, model: Model, work: Workspace | None = None) -> DataFrame:
    """doc_id and score for every row of ``docs``: 0 to 1, higher where toxicity is likelier."""
    held = (work or Workspace(docs.sparkSession, "toxicity")).broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, judge = held.value, Judge(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ARROW_ROWS):
                part = batch.slice(at, ARROW_ROWS)
                out = [model.score(f) for f in judge.features(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])
        del judge
        release()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def may_learn(doc_id: str = "doc_id"):
    """Rows whose labels may be learnt from: crc32 of the id as text leaves no 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 != 2, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null, empty and blank texts get the score of no evidence. A null doc_id is scored and not held out. Without any
    labels all scores are near 0. Repeated rows stay repeated; an empty table gives an empty result."""
    work = Workspace(docs.sparkSession, "toxicity")
    model = learn(work, docs, labels.filter(may_learn()))
    return scores(docs, model, work).select("doc_id", (~may_learn()).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, whatever their names.

    Null, empty and very long texts, repeated rows and rows without a doc_id are judged as in ``toxicity``; without
    labels nothing goes; an empty table gives an empty result."""
    work = Workspace(docs.sparkSession, "toxicity")
    model = learn(work, docs, labels.filter(may_learn()))
    held = work.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, judge = held.value, Judge(held.value)
        for batch in batches:
            for row in range(0, batch.num_rows, ARROW_ROWS):
                part = batch.slice(row, ARROW_ROWS)
                keep = [model.score(f) < cut for f in judge.features(part.column(at).to_pylist())]
                yield part.filter(pa.array(keep, pa.bool_()))
        del judge
        release()

    return docs.mapInArrow(run, docs.schema)
