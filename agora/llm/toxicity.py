"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Labels are of documents; tokens get theirs from them: in toxic documents, words that toxic documents have far more often
than others are toxic, all else is not. The field has two states, weights of hashed word, prefix and suffix features, and
transitions; with two states a forward or backward message is one number, the log-odds of the toxic state. Marginals are
summed up per document, and a logistic regression on those sums, fitted on documents the field hasn't seen, gives the score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.runtime import chunks, in_rows, text_of
from agora.llm.textkernel import Words, mix, stretch_hashes, words

#: Labelled rows that a model is fitted on at most: toxic, others, and the characters of each of them.
TOXIC_ROWS, OTHER_ROWS, ROW_CHARS = 2000, 3000, 60_000
#: Words of a block: what the field learns from, and the steps between which messages are carried through a text.
BLOCK = 64
#: Blocks that the field learns from at most, and its passes over them and steps at least.
BLOCKS, PASSES, STEPS = 16_000, 6, 300
#: Share of words that it learns from by their place alone, so that it knows how seldom an unknown word is toxic.
UNKNOWN = 0.15
FEATURES = 1 << 18
#: A word of toxic documents is toxic if so large a share of them has it, and so many times the share of the others.
SHARE, LIFT = 0.005, 8.0

BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32


@dataclass
class Model:
    """weights: per feature, the last is the bias; moves: score of state i then j; start; curve: of the document score."""

    weights: np.ndarray
    moves: np.ndarray
    start: float
    curve: np.ndarray


def tokens(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of letters and digits, their hashes, and the feature numbers of each (word, prefix, suffix)."""
    w = words(texts, BETWEEN)
    data = UPPER[w.data]
    whole = stretch_hashes(data, w.starts, w.ends)
    head = stretch_hashes(data, w.starts, np.minimum(w.starts + 5, w.ends)) + np.uint64(101)
    tail = stretch_hashes(data, np.maximum(w.ends - 4, w.starts), w.ends) + np.uint64(211)
    size = np.uint64(FEATURES - 1)
    return w, whole, np.stack([(x % size).astype(np.int32) for x in (whole, head, tail)], axis=1)


def blocks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words counted by text: each one's block and place there, the length of each block, the blocks of each text."""
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    n = -(-counts // BLOCK)
    block = np.repeat(np.cumsum(n) - n, counts) + at // BLOCK
    return block, at % BLOCK, np.bincount(block, minlength=int(n.sum())), n


def messages(e: np.ndarray, length: np.ndarray, moves: np.ndarray, entry: np.ndarray | float, after: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the place's own evidence) and backward log-odds; e: evidence by block and place; entry: what each
    block's first word has from before; after: what its last word has from behind."""
    n, width = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    if not width:
        return a, b
    a[:, 0] = e[:, 0] + entry
    for t in range(1, width):
        a[:, t] = e[:, t] + step(a[:, t - 1], moves)
    b[:, width - 1] = after
    for t in range(width - 2, -1, -1):
        b[:, t] = np.where(t + 1 < length, step(e[:, t + 1] + b[:, t + 1], moves.T), after)
    return a, b


def step(x: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log-odds after a move, from those before."""
    return np.logaddexp(moves[0, 1], x + moves[1, 1]) - np.logaddexp(moves[0, 0], x + moves[1, 0])


def transfers(e: np.ndarray, length: np.ndarray, moves: np.ndarray, first: np.ndarray, start: float) -> np.ndarray:
    """For each block the product of its words' moves and evidence, scaled: a text's messages pass a block in one step."""
    n, width = e.shape
    move = np.exp(moves - moves.max())
    opening = np.exp(np.array([[0.0, start]] * 2) - max(start, 0.0))
    out = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
    for t in range(width):
        by = np.where(first[:, None, None], opening, move) if t == 0 else move
        top = np.maximum(e[:, t], 0.0)
        made = out @ by * np.exp(np.stack([-top, e[:, t] - top], axis=1))[:, None, :]
        made /= made.max(axis=(1, 2), keepdims=True)
        out = np.where((t < length)[:, None, None], made, out)
    return out + 1e-300


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def evidence(model: Model, features: np.ndarray) -> np.ndarray:
    return model.weights[features].sum(axis=1) + model.weights[-1]


def marginals(model: Model, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The probability of each word to be toxic, by forward and backward messages through its whole text."""
    block, place, length, n = blocks_of(counts)
    e = np.zeros((len(length), int(length.max()) if len(length) else 0))
    e[block, place] = evidence(model, features)
    head = np.zeros(len(length), bool)
    head[(np.cumsum(n) - n)[n > 0]] = True
    entry, after = np.where(head, model.start, 0.0), np.zeros(len(length))
    through = transfers(e, length, model.moves, head, model.start) if (n > 1).any() else None
    first, last = np.cumsum(n) - n, np.cumsum(n) - 1
    ends = np.zeros(len(length))  # forward log-odds at each block's end
    for k in range(int(n.max()) - 1 if len(n) else 0):
        at = first[n > k + 1] + k
        ends[at] = carried(ends[at - 1] if k else np.zeros(len(at)), through[at])
        entry[at + 1] = step(ends[at], model.moves)
        at = last[n > k + 1] - k
        after[at - 1] = carried(after[at], through[at].transpose(0, 2, 1))
    a, b = messages(e, length, model.moves, entry, after)
    return sigmoid((a + b)[block, place])


def carried(x: np.ndarray, through: np.ndarray) -> np.ndarray:
    """Log-odds on the other side of blocks."""
    p = np.stack([sigmoid(-x), sigmoid(x)], axis=1)[:, None, :] @ through
    return np.log(p[:, 0, 1]) - np.log(p[:, 0, 0])


def sums(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document: constant, summed squares and count of the marginals, the largest, and their density.

    Squares keep the many words of a long text that are hardly toxic from adding up.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(doc, weights=p * p, minlength=len(counts))
    hits = np.bincount(doc, weights=p >= 0.5, minlength=len(counts))
    most = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, (np.cumsum(counts) - counts)[some])
    return np.stack([np.ones(len(counts)), np.log1p(total), np.log1p(hits), most, np.log1p(100 * total / np.maximum(counts, 1))], axis=1)


def learn_field(features: np.ndarray, y: np.ndarray, counts: np.ndarray, seed: int = 7) -> Model:
    """Weights by stochastic gradient ascent of the conditional likelihood, each step scaled by its past gradients."""
    block, _, length, _ = blocks_of(counts)
    rng = np.random.default_rng(seed)
    toxic = np.bincount(block, weights=y, minlength=len(length)) > 0
    picked = np.concatenate([rng.permutation(np.flatnonzero(toxic))[: BLOCKS // 2], rng.permutation(np.flatnonzero(~toxic))[: BLOCKS // 2]])
    first = np.searchsorted(block, np.arange(len(length)))
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, np.zeros(5))
    model.weights[-1] = -2.0
    past, past_moves, past_start = np.full(FEATURES, 1e-6), np.full((2, 2), 1e-6), 1e-6
    parts = max(1, len(picked) // 256)
    for _ in range(max(PASSES, -(-STEPS // parts))):
        for part in np.array_split(rng.permutation(picked), parts):
            own = length[part]
            rows = np.repeat(np.arange(len(part)), own)
            cols = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            at = first[part][rows] + cols
            e, truth = np.zeros((len(part), int(own.max()))), np.zeros((len(part), int(own.max())))
            known = rng.random(len(at)) >= UNKNOWN
            e[rows, cols], truth[rows, cols] = model.weights[features[at]].sum(axis=1) * known + model.weights[-1], y[at]
            a, b = messages(e, own, model.moves, model.start)
            p = sigmoid(a + b)
            error = (truth - p)[rows, cols]
            pull = np.bincount(features[at].ravel(), weights=np.repeat(error * known, features.shape[1]), minlength=FEATURES)
            pull[-1] = error.sum()
            pull -= 1e-3 * model.weights * (pull != 0)
            past += pull * pull
            model.weights += 0.3 * pull / np.sqrt(past)
            inside = np.arange(1, e.shape[1])[None, :] < own[:, None]
            logs = np.stack([i * a[:, :-1] + model.moves[i, j] + j * (e + b)[:, 1:] for i in (0, 1) for j in (0, 1)])
            odds = np.exp(logs - logs.max(axis=0, initial=-np.inf))
            odds /= odds.sum(axis=0)
            real = np.stack([(truth[:, :-1] == i) & (truth[:, 1:] == j) for i in (0, 1) for j in (0, 1)])
            pull_moves = ((real - odds) * inside).sum(axis=(1, 2)).reshape(2, 2)
            past_moves += pull_moves**2
            model.moves += 0.1 * pull_moves / np.sqrt(past_moves)
            pull_start = float((truth[:, 0] - p[:, 0]).sum())
            past_start += pull_start**2
            model.start += 0.1 * pull_start / past_start**0.5
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the ridge spares the constant."""
    w = np.zeros(x.shape[1])
    damp = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (y - p) - damp @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of the labelled rows whose crc32(doc_id) mod 5 isn't 0.

    Documents with contradicting labels are left out. With no label of either class the score is constant: that class's
    share, 0 or 1, or 0 without labels.
    """
    spark = docs.sparkSession
    learnable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.where(learnable & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).where("y = z").select("label_id", "y")
    order = [F.xxhash64("label_id"), F.col("label_id")]
    sample = known.where("y = 1").orderBy(*order).limit(TOXIC_ROWS).union(known.where("y = 0").orderBy(*order).limit(OTHER_ROWS))
    sample = spark.createDataFrame(sample.collect(), "label_id long, y int")  # at most TOXIC_ROWS + OTHER_ROWS rows
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).where(F.coalesce(F.length("text"), F.lit(0)) <= ROW_CHARS).select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            w, whole, features = tokens(text_of(chunk, "text"))
            edges = pa.array(w.first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (whole.view(np.int64), *np.ascontiguousarray(features.T))]
            yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), *lists], names=["doc_id", "y", "word", "f0", "f1", "f2"])

    rows = chosen.mapInArrow(run, "doc_id long, y int, word array<long>, f0 array<int>, f1 array<int>, f2 array<int>")

    names = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("word", pa.list_(pa.int64())), *((f"f{k}", pa.list_(pa.int32())) for k in range(3))])

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(pa.Table.from_batches(batches, names)))])], names=["model"])

    # One task learns from the bounded sample; the driver gets the model alone.
    found = rows.repartition(1).mapInArrow(teach, "model binary").first()
    return pickle.loads(found["model"]) if found else learn(names.empty_table())


def learn(rows: pa.Table) -> Model:
    """The model of documents given as doc_id, y, word hashes and feature numbers."""
    rows = rows.sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    y = rows.column("y").to_numpy()
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, np.zeros(5))
    if not (y == 1).any() or not (y == 0).any():
        model.curve[0] = 50.0 if (y == 1).any() else -50.0
        return model
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
    counts = rows.column("word").combine_chunks().value_lengths().to_numpy().astype(np.int64)
    # Two thirds of the documents teach the field, the others the curve.
    teach = mix(rows.column("doc_id").to_numpy().view(np.uint64)) % np.uint64(3) != 0
    if len(np.unique(y[teach])) < 2 or len(np.unique(y[~teach])) < 2:
        teach = np.ones(len(y), bool)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    of = teach[doc]
    kinds, index = np.unique(flat("word"), return_inverse=True)
    index = index.astype(np.int32)
    seen = np.unique(index[of] * np.int64(len(counts)) + doc[of])
    kind, owner = seen // len(counts), seen % len(counts)
    with_ = [np.bincount(kind[y[owner] == k], minlength=len(kinds)) for k in (0, 1)]
    n = [int((teach & (y == k)).sum()) for k in (0, 1)]
    toxic = (with_[1] >= max(3, SHARE * n[1])) & (with_[1] / n[1] >= LIFT * (with_[0] + 0.5) / n[0])
    truth = toxic[index] & (y[doc] == 1)
    del seen, kind, owner, kinds, index
    features = np.stack([flat(f"f{k}") for k in range(3)], axis=1)
    model = learn_field(features[of], truth[of].astype(np.float64), counts[teach])
    check = ~teach if not teach.all() else teach
    seen_by = np.repeat(check, counts)
    model.curve = logistic(sums(marginals(model, features[seen_by], counts[check]), counts[check]), y[check].astype(np.float64))
    return model


def spans_of(w: Words, p: np.ndarray) -> pa.ListArray:
    """Per text, start and end (in characters) of each run of toxic words, and the largest marginal there."""
    heads = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    hot = np.flatnonzero(p >= 0.5)
    doc = w.doc()
    new = np.ones(len(hot), bool)
    new[1:] = (np.diff(hot) > 1) | (np.diff(doc[hot]) > 0)
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(hot)) - 1 if len(opens) else opens
    base = heads[w.bounds[doc[hot[opens]]]]
    parts = [heads[w.starts[hot[opens]]] - base, heads[w.ends[hot[closes]]] - base, np.maximum.reduceat(p[hot], opens) if len(opens) else np.zeros(0)]
    inner = pa.StructArray.from_arrays([pa.array(x) for x in parts], names=["start", "end", "marginal"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[hot[opens]], np.arange(len(w.bounds))).astype(np.int32)), inner)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (the columns of ``docs``), score, spans (array of start, end, marginal) for every row.

    Nulls are empty texts. Repeated rows and null ids are scored like others: a score depends on the text alone.
    """
    rows = in_rows(docs)
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("score double, spans array<struct<start: long, end: long, marginal: double>>")])
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            w, _, features = tokens(text_of(chunk, "text"))
            p = marginals(held.value, features, w.counts)
            found = sigmoid(sums(p, w.counts) @ held.value.curve)
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(found), spans_of(w, p)], names=["row", "score", "spans"])

    return rows.mapInArrow(run, schema)
