"""LM scoring by a hidden Markov language model (operator 7).

Tokens are the words of a text, A-Z lowered, and one end. Counts of all training words are gathered over the cluster;
the ``most_words`` most frequent ones, the end, and the class of all other words are the symbols that the latent
states emit. States are trained by Baum-Welch: every round, each partition runs the scaled forward and backward
recursions over its training texts and sends expected counts, which are added up by symbol; rounds go on until the
likelihood of a token grows by less than ``SETTLED`` or ``rounds`` are done. Before that, the states are set apart by
rounds on a bounded sample of whole texts on the driver, those with the least hashes of their ids at every input size. The score of a text is its exact likelihood by the scaled
forward recursion. A word of the rare class has the probability of the class in its state times its share of the
class by counts, so the rare words' part adds up apart: their counts are met in a join and never broadcast.

The broadcast model has at most ``most_words`` + 2 symbols; the table of counts grows with the corpus and stays on the
executors. Rare words meet their counts by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import as_binary, words
from .workspace import Workspace, least_hashes

STATES, MOST_WORDS, ROUNDS, SETTLED, SAMPLE_TEXTS, SAMPLE_ROUNDS, ADD, PRIOR, SEED = 8, 65_000, 4, 0.002, 600, 12, 0.1, 5.0, 3


@dataclass
class Hmm:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states); its columns sum to one


class Batch:
    """Texts as symbols, laid out by time: all first symbols, all second ones, …, the longest text first."""

    def __init__(self, texts: list[np.ndarray]):
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        self.order = np.argsort(-lens, kind="stable")
        lens = lens[self.order]
        flat = np.concatenate([texts[k] for k in self.order]).astype(np.int64)
        time = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        rank = np.repeat(np.arange(len(lens)), lens)
        self.active = np.bincount(time)
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        place = self.at[time] + rank
        self.symbols, self.rank = np.empty_like(flat), np.empty_like(rank)
        self.symbols[place], self.rank[place] = flat, rank


def forward(model: Hmm, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward probabilities, their scales, and the emissions, all by time."""
    emitted = model.emit[batch.symbols]
    alpha, scale = np.empty_like(emitted), np.empty(len(emitted))
    for t, n in enumerate(batch.active.tolist()):
        a = batch.at[t]
        x = (alpha[batch.at[t - 1] : batch.at[t - 1] + n] @ model.move if t else model.start) * emitted[a : a + n]
        c = x.sum(axis=1)
        scale[a : a + n] = c
        np.divide(x, c[:, None], out=alpha[a : a + n])
    return alpha, scale, emitted


def likelihoods(model: Hmm, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text, which has one symbol at least."""
    batch = Batch(texts)
    _, scale, _ = forward(model, batch)
    out = np.empty(len(texts))
    out[batch.order] = np.bincount(batch.rank, weights=np.log10(scale), minlength=len(texts))
    return out


def expected(model: Hmm, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions by the forward and backward recursions, and the texts' log10 likelihood."""
    batch = Batch(texts)
    alpha, scale, emitted = forward(model, batch)
    moves, beta, ahead = np.zeros_like(model.move), np.ones((0, model.move.shape[0])), 0
    for t in range(len(batch.active) - 1, -1, -1):
        a, n = batch.at[t], batch.active[t]
        now = np.ones((n, model.move.shape[0]))
        if ahead:
            b = batch.at[t + 1]
            next_ = emitted[b : b + ahead] * beta / scale[b : b + ahead, None]
            now[:ahead] = next_ @ model.move.T
            moves += alpha[a : a + ahead].T @ next_
        beta, ahead = now, n
        alpha[a : a + n] *= now
    symbols, states = model.emit.shape
    emits = np.column_stack([np.bincount(batch.symbols, weights=alpha[:, s], minlength=symbols) for s in range(states)])
    return alpha[: batch.active[0]].sum(axis=0), moves * model.move, emits, float(np.log10(scale).sum())


def improved(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, common: np.ndarray, prior: float = PRIOR) -> Hmm:
    """The model of expected counts, smoothed towards the symbols' common shares."""
    states = len(starts)
    emits = emits + prior * states * common[:, None]
    return Hmm((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emits / emits.sum(axis=0, keepdims=True))


def begin(common: np.ndarray, sample: list[np.ndarray], states: int, rounds: int, seed: int) -> Hmm:
    """States set apart on a sample: random emissions at first, then rounds of Baum-Welch."""
    rng = np.random.default_rng(seed)
    emit = common[:, None] * rng.gamma(1.0, 1.0, (len(common), states)) + 1e-12
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    model = Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0))
    for _ in range(rounds if sample else 0):
        added = [expected(model, part)[:3] for part in groups(sample)]
        model = improved(*(sum(x) for x in zip(*added, strict=True)), common)
    return model


def groups(texts: list[np.ndarray], most: int = 400_000) -> Iterator[list[np.ndarray]]:
    """Texts of like length together, about so many symbols at a time."""
    part, held = [], 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        part.append(texts[k])
        held += len(texts[k])
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(table: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(table), pa.binary()), pa.array(list(table.values()), pa.int64())], ["word", "n"])

    table: Counter = Counter()
    for batch in batches:
        for text in as_binary(batch.column(0)).to_pylist():
            table.update(words(text))
            if len(table) > 300_000:
                yield told(table)
                table = Counter()
    if table:
        yield told(table)


def _encoder(vocabulary):
    """(doc_id, held_out, text) -> the symbols of the text and its rare words by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(vocabulary.value)}
        rare, row = len(place), TaskContext.get().partitionId() << 34
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, hashes, times = [], [], []
                for text in as_binary(part.column(2)).to_pylist():
                    own = words(text)
                    known = np.fromiter(map(place.get, own, repeat(rare)), dtype=np.uint16, count=len(own))
                    ids.append(known.tobytes())
                    others = Counter([own[k] for k in np.flatnonzero(known == rare).tolist()])
                    hashes.append([xxhash.xxh64_intdigest(w, 42) - ((1 << 64) if xxhash.xxh64_intdigest(w, 42) >> 63 else 0) for w in others])
                    times.append(list(others.values()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + part.num_rows)), part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                    ["row", "doc_id", "held_out", "ids", "rare", "times"])
                row += part.num_rows
    return run


def _symbols(packed: list[bytes], end: int) -> list[np.ndarray]:
    return [np.append(np.frombuffer(x, dtype=np.uint16), np.uint16(end)) for x in packed]


def _expector(held):
    """Symbols of texts -> expected counts; the rows after the symbols are the starts, the moves and the likelihood."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = held.value
        symbols, states = model.emit.shape
        total = np.zeros((symbols + 2 + states, states))
        for batch in batches:
            for part in groups(_symbols(batch.column(0).to_pylist(), symbols - 1)):
                starts, moves, emits, likelihood = expected(model, part)
                total[:symbols] += emits
                total[symbols] += starts
                total[symbols + 1 : symbols + 1 + states] += moves
                total[-1] += likelihood
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, s]) for s in range(states))], ["symbol", *(f"g{s}" for s in range(states))])
    return run


def _scorer(held, known_logs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs = held.value, known_logs.value
        symbols = model.emit.shape[0]
        for batch in batches:
            texts = _symbols(batch.column(3).to_pylist(), symbols - 1)
            score = np.zeros(len(texts))
            order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            at = 0
            for part in groups(texts):
                score[order[at : at + len(part)]] = likelihoods(model, part)
                at += len(part)
            plain = np.array([logs[t].sum() for t in texts], dtype=float)
            rare = np.array([(t == symbols - 2).sum() for t in texts], dtype=np.int64)
            size = np.array([len(t) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(size), pa.array(rare), pa.array(plain), pa.array(score)],
                                             ["row", "doc_id", "held_out", "n_tokens", "n_rare", "plain", "score"])
    return run


def held_out(doc_id: str = "doc_id"):
    """Texts that are not learnt from: crc32 of the id as text divides by 10. A null id is learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 10 == 0, F.lit(False))


def score(docs: DataFrame, states: int = STATES, most_words: int = MOST_WORDS, rounds: int = ROUNDS, sample_texts: int = SAMPLE_TEXTS, settled: float = SETTLED, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    ``score`` is the log10 probability of the text by the hidden Markov model, ``base_score`` by single words with
    0.1 added to each count. A null, empty or blank text is its end alone. Repeated rows count and are scored each; a
    null doc_id is learnt from. Without training texts every token is unknown and base_score is 0. An empty table
    gives an empty result."""
    if most_words + 2 > 65_536:
        raise ValueError("symbols are kept in 16 bits")
    work = Workspace(docs.sparkSession, "hmm")
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    training = rows.filter(~F.col("held_out"))
    counts = work.save(training.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    known = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = training.count()
    n, v = known["n"] + ends, known["v"] + (1 if ends else 0)
    mass = n + ADD * (v + 1)
    # words above the least count at which they are most_words or fewer, and of that count the first by their bytes: sorted on the driver, whatever the corpus
    held_by = counts.groupBy("c").agg(F.count("*").alias("m")).orderBy(F.desc("c")).limit(most_words + 1).collect()
    sums = np.cumsum([r["m"] for r in held_by])
    cut = next((r["c"] for r, total in zip(held_by, sums, strict=True) if total > most_words), 0)
    top = counts.filter(F.col("c") > cut).toArrow()
    tied = counts.filter(F.col("c") == cut).orderBy("word").limit(most_words - top.num_rows).toArrow()
    best = sorted((-c, w) for part in (top, tied) for c, w in zip(part.column(1).to_pylist(), part.column(0).to_pylist(), strict=True))
    frequent, often = [w for _, w in best], np.array([-c for c, _ in best], dtype=float)
    rare_mass = max(known["n"] - often.sum() + ADD * (known["v"] - len(frequent)) + ADD, ADD)
    shares = np.concatenate([often + ADD, [rare_mass, ends + ADD]])
    encoded = work.save(rows.mapInArrow(_encoder(work.broadcast(frequent)), f"row long, doc_id {kind}, held_out boolean, ids binary, rare array<long>, times array<long>"), "encoded")
    common = shares / shares.sum()
    texts = encoded.filter(~F.col("held_out"))
    drawn = least_hashes(texts, F.col("doc_id"), sample_texts, ends, seed).select("ids").toArrow().column(0).to_pylist()
    model, last = begin(common, _symbols(sorted(drawn), len(common) - 1), states, SAMPLE_ROUNDS, seed), -np.inf
    for _ in range(rounds if ends else 0):
        held = work.broadcast(model)
        found = texts.select("ids").mapInArrow(_expector(held), "symbol int, " + ", ".join(f"g{s} double" for s in range(states)))
        added = found.groupBy("symbol").agg(*(F.sum(f"g{s}").alias(f"g{s}") for s in range(states))).toArrow()  # a row for each symbol at most
        total = np.zeros((len(common) + 2 + states, states))
        total[added.column(0).to_numpy()] = np.column_stack([added.column(s + 1).to_numpy() for s in range(states)])
        model = improved(total[len(common)], total[len(common) + 1 : -1], total[: len(common)], common)
        work.forget(held)
        now = total[-1, 0] / n
        if now - last < settled:
            break
        last = now
    logs = np.log10(np.concatenate([often + ADD, [1.0, ends + ADD]]))  # rare words add theirs later
    scored = encoded.select("row", "doc_id", "held_out", "ids").mapInArrow(
        _scorer(work.broadcast(model), work.broadcast(logs)), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_rare long, plain double, score double")
    pairs = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("hash"), F.col("r.times").alias("times"))
    met = pairs.join(counts.select(F.xxhash64("word").alias("hash"), "c").hint("merge"), "hash", "left")
    others = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("seen"))
    out = scored.join(others.hint("merge"), "row", "left")
    logs_ = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - F.col("n_rare") + F.coalesce("seen", F.lit(0)) - (0 if ends else 1)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("plain") + logs_ - F.col("n_tokens") * float(np.log10(mass))).alias("base_score"),
        (F.col("score") + logs_ - F.col("n_rare") * float(np.log10(rare_mass))).alias("score"))
