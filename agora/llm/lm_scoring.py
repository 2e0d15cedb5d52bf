"""Log-likelihood of documents under a gated recurrent language model that is trained here.

A token is a word in lower case (A-Z) or the end of a document. Words are counted over all training documents. The most
frequent ones are *modelled*: a gated recurrent unit (GRU) gives a distribution over classes of words, and each class one
over its words. All other words make one class more, in which a word's share follows its count: (c + 1) / (N' + V' + 1)
with N' tokens and V' words of that kind, the 1 being what is left for words never seen. So the probabilities of all words
that there can be add up to one, and what the model knows grows with the corpus, though the network doesn't.

Training is truncated backpropagation in numpy, spread over the cluster: each document trains in one round, each trainer takes
about ``TOKENS`` tokens of the round's training documents, starts from the present weights, and carries the state of each lane of documents from
one window to the next; the trainers' weights are averaged in a tree of bounded sums. Biases start as logarithms of counts,
so that the untrained network is the unigram model already.

Scoring carries the state through whole documents, whatever their lengths: documents are lined up in lanes that advance
together, window by window. Words that aren't among the ``HOT`` most frequent ones are counted per document and joined with
the table of counts; no such word has more than one in ``HOT`` of all tokens, so that no key of that join is large.

Null texts are empty: one token, the end. Rows without an id are not learned from and not held out. Repeated rows are scored
each. Without training documents every token has the probability 1 of a vocabulary of none. What a task holds is bounded by
``BUFFER`` tokens or one document.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.runtime import chunks, release, table, text_of
from agora.llm.textkernel import SPACE, HashSlots, Words, all_equal, stretch_hashes, words

#: Words whose counts every task knows: those with at least one in HOT of the training tokens, so HOT at most.
HOT = 1 << 20
#: Of these the most frequent ones that the network tells apart, and the number of their classes.
MODELLED, CLASSES = 4096, 31
#: Units of the network.
UNITS = 16
#: Every training document trains the network in one of ROUNDS rounds, TOKENS tokens a trainer.
ROUNDS, TOKENS = 2, 1 << 21
#: A trainer's lanes, at least and at most, steps of a window, least number of windows (few documents are passed through
#: again), learning rate with the fewest lanes.
LANES, MOST_LANES, WINDOW, LEAST, RATE = 64, 256, 32, 200, 0.05
#: Of a trainer's documents, one in HELD judges the passes over the others, and is learned from after them.
HELD = 8
#: Tokens that a scoring task holds at once, lanes and steps of its windows.
BUFFER, WIDE, LONG = 1 << 22, 1024, 48
#: Tokens whose probabilities are worked on at once.
PIECE = 1 << 13
#: Models that are added up in one task.
ADDENDS = 32
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(texts: pa.Array) -> Words:
    found = words(texts)
    found.data = LOWER[found.data]
    return found


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches, which are all of ``data`` but its spaces, as an Arrow array."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~SPACE[data]])])


class Lexicon:
    """Numbers known words by their place in a list; others are -1. Equal hashes are compared byte by byte."""

    def __init__(self, known: list[bytes]):
        self.data = np.frombuffer(b"".join(known), np.uint8)
        self.ends = np.cumsum([len(w) for w in known], dtype=np.int64) if known else np.zeros(0, np.int64)
        self.starts = self.ends - np.array([len(w) for w in known], np.int64)
        self.turn = 0
        while True:  # until no two words have one hash
            h = self.hashes(self.data, self.starts, self.ends)
            if len(np.unique(h)) == len(h):
                break
            self.turn += 1
        self.slots = HashSlots(1 << max(4, (2 * len(known)).bit_length()))
        self.place = np.full(self.slots.size, -1, np.int32)
        self.place[self.slots.claim(h)] = np.arange(len(known))

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = stretch_hashes(data, starts, ends, self.turn)
        h[h == 0] = 1
        return h

    def number(self, found: Words) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Each word's number, and the words, each different one once. Only those are looked up."""
        each = strings(found.data, found.starts, found.ends).dictionary_encode()
        ends = np.frombuffer(each.dictionary.buffers()[1], np.int32)[: len(each.dictionary) + 1].astype(np.int64)
        data = np.frombuffer(each.dictionary.buffers()[2] or b"", np.uint8)
        return self.find(data, ends[:-1], ends[1:])[each.indices.to_numpy()], each

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at = self.place[self.slots.find(self.hashes(data, starts, ends))].astype(np.int64)
        hit = np.flatnonzero(at >= 0)
        size, to = (ends - starts)[hit], at[hit]
        alike = size == (self.ends - self.starts)[to]
        if not (alike.all() and all_equal(data, starts[hit], self.data, self.starts[to], size)):
            for k in range(len(hit)):  # two words with one hash: they are told apart one by one
                a, b = int(starts[hit[k]]), int(self.starts[to[k]])
                if not alike[k] or not np.array_equal(data[a : a + size[k]], self.data[b : b + size[k]]):
                    at[hit[k]] = -1
        return at


@dataclass
class Net:
    """The weights: token inputs of the three gates, recurrent weights, classes, words within classes."""

    counts: np.ndarray  #: of the modelled words, falling
    rest: float  #: tokens of all other words
    units: int = UNITS
    edges: np.ndarray = field(init=False)  #: first word of each class, and the number of words
    weights: dict[str, np.ndarray] = field(init=False)

    def __post_init__(self):
        n = len(self.counts)
        mass = np.cumsum(np.sqrt(self.counts)) if n else np.zeros(0)
        cut = np.searchsorted(mass, mass[-1] * np.arange(1, CLASSES) / CLASSES) if n else []
        self.edges = np.unique(np.concatenate([[0], cut, [n]]).astype(np.int64))
        self.class_of = np.append(np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges)), len(self.edges) - 1).astype(np.int32)
        rng = np.random.default_rng(12)
        classes, u = len(self.edges), self.units
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        heavy = np.append(np.add.reduceat(self.counts, self.edges[:-1]) if n else [], self.rest) + 1.0
        within = np.log(self.counts + 0.0) - np.log(heavy - 1)[self.class_of[:-1]] if n else np.zeros(0)
        self.weights = {
            "inputs": small(n + 1, 3 * u),
            "gates": (rng.standard_normal((u, 3 * u)) / np.sqrt(u)).astype(np.float32),
            "classes": small(u, classes),
            "class_bias": np.log(heavy / heavy.sum()).astype(np.float32),
            "words": small(n, u),
            "word_bias": within.astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def load(self, flat: np.ndarray) -> None:
        self.weights = unflatten(flat, self.weights)

    # --- forward: a column for each lane, so that the gates lie in one piece each

    def steps(self, h: np.ndarray, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the state h (units x lanes) on over a window (steps x lanes; -1: nothing there).

        The states before each step and after the last (steps + 1, units, lanes); of each step the gates keep (z), reset (r)
        and the recurrent part of new (q), one below the other (3 units); and new (n).
        """
        u, kind = self.units, self.weights["gates"].dtype
        inputs, gates = self.weights["inputs"], self.weights["gates"].T.copy()
        gates[: 2 * u] *= -1  # exp(-x) is what the gates z and r take
        safe, fresh = np.maximum(tokens, 0), begins.any(1)
        shape = (u, tokens.shape[1])
        states, news = np.empty((len(tokens) + 1, *shape), kind), np.empty((len(tokens), *shape), kind)
        zrqs = np.empty((len(tokens), 3 * u, shape[1]), kind)
        states[0] = h
        zs, rs, qs, zrs = zrqs[:, :u], zrqs[:, u : 2 * u], zrqs[:, 2 * u :], zrqs[:, : 2 * u]
        for s, after, zrq, zr, z, r, q, n, at, new, some in zip(states[:-1], states[1:], zrqs, zrs, zs, rs, qs, news, safe, begins, fresh.tolist(), strict=True):
            if some:
                s[:, new] = 0
            x = inputs.take(at, 0).T
            np.matmul(gates, s, out=zrq)
            np.subtract(zr, x[: 2 * u], out=zr)
            np.exp(zr, out=zr)
            np.add(zr, 1, out=zr)
            np.reciprocal(zr, out=zr)
            np.multiply(r, q, out=n)
            np.add(n, x[2 * u :], out=n)
            np.tanh(n, out=n)
            np.subtract(s, n, out=after)
            np.multiply(after, z, out=after)
            np.add(after, n, out=after)
        return states, zrqs, news

    def log_probabilities(self, states: np.ndarray, tokens: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log P of each token after its state (a row): of its class, and of the word in it (all other words: of their class alone).

        With ``grads``, adds the gradients of the mean negative log P to it and returns those by the states, too.
        """
        order = in_order(tokens)
        out, back = self.sorted_logs(taken(states.T, order), tokens[order], grads)
        place = np.argsort(order)
        return out[place], None if back is None else back[place]

    def sorted_logs(self, states: np.ndarray, tokens: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The same for rising tokens, so that those of a class follow each other, and states that are columns, with a one below each."""
        w, of, n, u = self.weights, self.class_of[tokens], len(tokens), self.units
        classes, words = np.vstack([w["classes"], w["class_bias"]]).T, np.hstack([w["words"], w["word_bias"][:, None]])
        every, out, back = np.arange(min(n, PIECE)), np.empty(n, states.dtype), None
        if grads is not None:
            back, mean = np.empty((n, u), states.dtype), (states / np.asarray(n, states.dtype)).T
            by_class, by_word = np.zeros_like(classes), np.zeros_like(words)
        for lo in range(0, n, PIECE):
            at = slice(lo, min(n, lo + PIECE))
            k, places = of[at], every[: at.stop - lo]
            out[at], share = softmax((classes @ states[:, at]).T, places, k, grads is not None)
            if share is not None:
                less_one(share, places, k)
                np.matmul(share, w["classes"].T, out=back[at])
                by_class += share.T @ mean[at]
        ends = np.searchsorted(of, np.arange(len(self.edges))).tolist()
        for a, b, begin, end in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), ends[:-1], ends[1:], strict=True):
            if b == a + 1:
                continue
            for lo in range(begin, end, PIECE):
                at = slice(lo, min(end, lo + PIECE))
                t, places = tokens[at] - a, every[: at.stop - lo]
                logs, share = softmax((words[a:b] @ states[:, at]).T, places, t, grads is not None)
                out[at] += logs
                if share is not None:
                    less_one(share, places, t)
                    back[at] += share @ w["words"][a:b]
                    by_word[a:b] += share.T @ mean[at]
        if grads is None:
            return out, None
        back /= n
        grads["classes"] += by_class[:, :u].T
        grads["class_bias"] += by_class[:, u]
        grads["words"] += by_word[:, :u]
        grads["word_bias"] += by_word[:, u]
        return out, back

    # --- truncated backpropagation

    def window(self, h: np.ndarray, tokens: np.ndarray, begins: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Mean negative log P of a window (steps x lanes; -1: nothing there), the state after it (lanes x units), the gradients within it.

        Those of the inputs are the tokens that occur, and a row for each.
        """
        w, u = self.weights, self.units
        states, zrqs, news = self.steps(h.T, tokens, begins)
        flat = tokens.ravel()
        order = in_order(flat)
        order = order[int((flat < 0).sum()) :]
        found = flat[order]
        before = by_unit(states[:-1])
        grads = {k: np.zeros_like(x) for k, x in w.items() if k != "inputs"}
        logs, back = self.sorted_logs(taken(before, order), found, grads)
        d_states = np.zeros((len(flat), u), before.dtype)
        d_states[order] = back
        d_states = d_states.reshape(*tokens.shape, u).transpose(0, 2, 1)
        # what of the state's gradient goes to the gates, for all steps at once
        z, r, q = zrqs[:, :u], zrqs[:, u : 2 * u], zrqs[:, 2 * u :]
        to_new = 1 - z
        to_keep = states[:-1] - news
        to_keep *= z
        to_keep *= to_new
        news *= news
        to_new *= np.subtract(1, news, out=news)
        to_reset = 1 - r
        to_reset *= r
        to_reset *= q
        fresh, dh = begins.any(1), np.zeros_like(states[0])
        dg, da = np.empty_like(zrqs), news
        each = (dg, dg[:, :u], dg[:, u : 2 * u], dg[:, 2 * u :], da, to_keep, to_new, to_reset, z, r, d_states, begins)
        for some, g, dz, dr, dq, a, keep, new, reset, zt, rt, d, start in zip(fresh[::-1].tolist(), *(x[::-1] for x in each), strict=True):
            np.multiply(dh, keep, out=dz)
            np.multiply(dh, new, out=a)
            np.multiply(a, reset, out=dr)
            np.multiply(a, rt, out=dq)
            np.multiply(dh, zt, out=dh)
            np.add(dh, w["gates"] @ g, out=dh)
            np.add(dh, d, out=dh)
            if some:
                dh[:, start] = 0
        grads["gates"] += np.matmul(states[:-1], dg.transpose(0, 2, 1)).sum(0)
        dg[:, 2 * u :] = da
        first = np.flatnonzero(np.diff(found, prepend=-1))
        grads["inputs"] = found[first], np.add.reduceat(by_unit(dg).take(order, 1), first, 1).T
        return -float(logs.mean()), states[-1].T, grads

    def train(self, texts: list[np.ndarray], memory: np.ndarray | None = None) -> np.ndarray:
        """Learns from documents (token arrays) by Adagrad; the sums of squares at the end. Changes the weights.

        One document in HELD judges first: the weights after the pass that it likes best stay, be it none. A pass is repeated
        until LEAST windows are done or the judgement is worse. Then the judges are learned from, if a pass stayed.
        """
        squares = unflatten(np.full(sum(x.size for x in self.weights.values()), 1e-6, np.float32) if memory is None else memory, self.weights)
        judges, others = texts[::HELD], [x for k, x in enumerate(texts) if k % HELD]
        best, kept, done, liked = self.score(judges).sum(), (self.flat(), squares), 0, False
        while done < LEAST and others:
            squares, windows = self.learn(others, squares)
            done += windows
            found = self.score(judges).sum()
            if found <= best:
                break
            best, kept, liked = found, (self.flat(), squares), True
        self.load(kept[0])
        squares = self.learn(judges, kept[1])[0] if liked else kept[1]
        return np.concatenate([x.ravel() for x in squares.values()])

    def learn(self, texts: list[np.ndarray], squares: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], int]:
        """One pass over documents: the sums of squares after it, and the number of windows. Changes the weights.

        Many tokens are spread over more lanes, which take longer steps, as long as LEAST windows are left.
        """
        size = sum(map(len, texts))
        wide = min(MOST_LANES, max(LANES, size // (LEAST * WINDOW)))
        rate = np.float32(RATE * np.sqrt(wide / LANES))
        tokens, _, begins = lanes(texts, wide)
        squares = {k: x.copy() for k, x in squares.items()}
        h = np.zeros((tokens.shape[1], self.units), np.float32)
        for lo in range(0, len(tokens), WINDOW):
            part, new = tokens[lo : lo + WINDOW], begins[lo : lo + WINDOW]
            live = int((part >= 0).any(0).sum())  # lanes are in order of length
            _, h, grads = self.window(h[:live], part[:, :live], new[:, :live])
            some, g = grads.pop("inputs")
            squares["inputs"][some] += g * g
            self.weights["inputs"][some] -= rate * g / np.sqrt(squares["inputs"][some])
            for k, g in grads.items():
                squares[k] += g * g
                self.weights[k] -= rate * g / np.sqrt(squares[k])
        return squares, -(-len(tokens) // WINDOW)

    # --- scoring

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """The sum of log P (natural) of each document's tokens, all other words as one."""
        tokens, doc, begins = lanes(texts, WIDE)
        out, h = np.zeros(len(texts)), np.zeros((self.units, tokens.shape[1]), np.float32)
        ends = (tokens >= 0).sum(0)  # falling
        lo = 0
        while lo < len(tokens):
            live = int(np.searchsorted(-ends, -lo))
            hi = lo + max(LONG, LONG * WIDE // live)  # where few lanes are left, more steps
            part = tokens[lo:hi, :live]
            states = self.steps(h[:, :live], part, begins[lo:hi, :live])[0]
            h = states[-1]
            flat = part.ravel()
            order = in_order(flat)
            order = order[int((flat < 0).sum()) :]
            logs, _ = self.sorted_logs(taken(by_unit(states[:-1]), order), flat[order])
            out += np.bincount(doc[lo:hi, :live].ravel()[order], logs.astype(np.float64), len(texts))
            lo = hi
        return out


def in_order(tokens: np.ndarray) -> np.ndarray:
    """Places of the tokens in rising order; numbers of 16 bits are sorted by their digits."""
    small = not len(tokens) or tokens.max() < 1 << 15
    return np.argsort(tokens.astype(np.int16) if small else tokens, kind="stable")


def taken(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """These columns, and a one below each, for the bias."""
    out = np.ones((len(states) + 1, len(order)), states.dtype)
    np.take(states, order, 1, out=out[:-1], mode="clip")
    return out


def less_one(share: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
    """Takes one from the chosen columns' shares, which are stored column by column."""
    share.T.reshape(-1)[chosen * len(rows) + rows] -= 1


def by_unit(states: np.ndarray) -> np.ndarray:
    """(steps, units, lanes) as a row for each unit."""
    return states.transpose(1, 0, 2).reshape(states.shape[1], -1)


@np.errstate(over="ignore")
def softmax(logits: np.ndarray, rows: np.ndarray, chosen: np.ndarray, shares: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The logarithms of the chosen columns' shares, and with ``shares`` all of them. Changes ``logits``."""
    own = logits.T.reshape(-1).take(chosen * len(rows) + rows)
    e = np.exp(logits)
    total = e.sum(1)
    if not np.isfinite(total.sum()):  # beyond the range of numbers: once more, below the largest
        top = logits.max(1)
        logits -= top[:, None]
        own, e = own - top, np.exp(logits)
        total = e.sum(1)
    out = own - np.log(total)
    if not shares:
        return out, None
    e /= total[:, None]
    return out, e


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([x.size for x in like.values()])
    return {k: part.reshape(x.shape).astype(np.float32) for (k, x), part in zip(like.items(), np.split(flat, ends[:-1]), strict=True)}


def lanes(texts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents one after the other in lanes of like length: tokens (steps x lanes, -1 behind the end), their documents, where they begin.

    Lanes are in order of falling length.
    """
    heap = [(0, k) for k in range(min(most, len(texts)))]
    inside: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(texts)), key=lambda d: -len(texts[d])):
        n, k = heapq.heappop(heap)
        inside[k].append(d)
        heapq.heappush(heap, (n + len(texts[d]), k))
    long = {k: n for n, k in heap}
    order = sorted(long, key=lambda k: -long[k])
    shape = (max(long.values(), default=0), len(order))
    tokens, doc, begins = np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape, bool)
    for lane, k in enumerate(order):
        at = 0
        for d in inside[k]:
            n = len(texts[d])
            tokens[at : at + n, lane], doc[at : at + n, lane], begins[at, lane] = texts[d], d, True
            at += n
    return tokens, doc, begins


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all rows' texts; the word "" is the end of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            found = lowered(text_of(chunk, "text"))
            counted = strings(found.data, found.starts, found.ends).value_counts()
            columns = [pa.concat_arrays([counted.field(0), pa.array([""])]), pa.concat_arrays([counted.field(1), pa.array([chunk.num_rows], pa.int64())])]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "c"])

    return docs.select(docs["text"].alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    counts: DataFrame  #: word, c: a table of all training words
    n: int  #: training tokens
    v: int  #: different ones
    hot: list[bytes]  #: words that tasks know, the most frequent first
    hot_counts: np.ndarray
    net: Net

    @property
    def rest(self) -> tuple[int, int]:
        """Tokens and words that aren't modelled."""
        return self.n - int(self.net.counts.sum()), self.v - len(self.net.counts)


_lexicons: dict[int, Lexicon] = {}


def numbered(hot: list[bytes]) -> Lexicon:
    """The words' lexicon, made once per worker and model."""
    key = hash((len(hot), *hot[:: max(1, len(hot) // 1000)]))
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(hot)
    return _lexicons[key]


def documents_of(found: Words, ids: np.ndarray, modelled: int, end: int) -> list[np.ndarray]:
    """Each text's tokens as the network numbers them: words that aren't modelled are number ``modelled``; the end is added."""
    ids = np.where((ids < 0) | (ids >= modelled), modelled, ids).astype(np.int32)
    return [np.append(ids[a:b], np.int32(end)) for a, b in zip(found.first[:-1], found.first[1:], strict=True)]


def learns(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def summed(models: DataFrame) -> DataFrame:
    """The sum of all rows' vectors, by sums of at most about ADDENDS a task, level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0.0
        for batch in batches:
            for w, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(x.as_py(), np.float32)
                total, weight = values.copy() if total is None else total + values, weight + w
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], names=["weight", "sums"])

    left = models.count()
    while left > 1:
        left = -(-left // ADDENDS)
        lower, models = models, table(models.repartition(left).mapInArrow(run, models.schema), "sums")
        release(lower)
        left = models.count() if left > 1 else 1
    return models


def fit(docs: DataFrame) -> Model:
    """Counts of all training rows of docs (doc_id, text), and the network trained on all of them."""
    train = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).where(learns(docs["doc_id"]))
    counts = table(word_counts(train), "words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # HOT rows at most, since the counts add up to n, and the end of a document
    found = counts.where((F.col("c") * HOT >= F.lit(sums["n"])) | (F.col("word") == "")).collect()
    found = sorted(((r["c"], r["word"].encode()) for r in found), key=lambda x: (-x[0], x[1]))
    hot, hot_counts = [w for _, w in found], np.array([c for c, _ in found], np.int64)
    chosen = min(MODELLED, len(hot))
    if b"" in hot and hot.index(b"") >= chosen:  # the end of a document is always modelled
        k = hot.index(b"")
        order = [*range(chosen - 1), k, *range(chosen - 1, k), *range(k + 1, len(hot))]
        hot, hot_counts = [hot[i] for i in order], hot_counts[order]
    net = Net(hot_counts[:chosen].astype(np.float64), float(sums["n"] - hot_counts[:chosen].sum()))
    model = Model(counts, sums["n"], sums["v"], hot, hot_counts, net)
    if not chosen:
        return model
    end, memory = hot.index(b""), None
    trainers = max(1, -(-sums["n"] // (ROUNDS * TOKENS)))
    known = hot[:chosen]
    for turn in range(ROUNDS):
        part = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn).select("text").repartition(trainers)
        models = table(part.mapInArrow(trainer(net, known, end, memory), "weight double, sums binary"), "models")
        total = summed(models)
        row = total.first()
        release(total)
        if row:
            values = np.frombuffer(row["sums"], np.float32) / np.float32(row["weight"])
            half = len(values) // 2
            net.load(values[:half])
            memory = values[half:].copy()
    return model


def trainer(net: Net, known: list[bytes], end: int, memory: np.ndarray | None) -> Callable:
    """A mapInArrow function: one row with a partition's number of tokens and, times that, its weights and sums of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, weight, held, size = copy.deepcopy(net), memory, 0, [], 0
        listed = pa.array(known, pa.binary()).cast(pa.string())
        for chunk in chunks(batches, "text"):
            found = lowered(text_of(chunk, "text"))
            each = strings(found.data, found.starts, found.ends).dictionary_encode()
            numbers = pc.fill_null(pc.index_in(each.dictionary, value_set=listed), -1).to_numpy()
            held += documents_of(found, numbers[each.indices.to_numpy()], len(known), end)
            size += len(found.starts) + chunk.num_rows
            if size >= BUFFER:
                state, weight, held, size = own.train(held, state), weight + size, [], 0
        if held:
            state, weight = own.train(held, state), weight + size
        if weight:
            vector = np.concatenate([own.flat(), state]) * np.float32(weight)
            yield pa.RecordBatch.from_arrays([pa.array([float(weight)]), pa.array([vector.tobytes()], pa.binary())], names=["weight", "sums"])

    return run


SCORED = "doc_id long, key long, n_tokens long, known long, base double, other long, other_base double, net double, tail array<struct<word: string, n: int>>"


def scorer(model: Model) -> Callable:
    """A mapInArrow function over (doc_id, key, text); see SCORED.

    known, base: of the tokens in ``hot``, their number and the sum of log10(c + 1). other, other_base: of those that the
    network doesn't model, their number, and that sum for those in ``hot``. net: log10 P of the tokens as the network sees them.
    """
    hot, logs, net, modelled = model.hot, np.log10(model.hot_counts + 1.0), model.net, len(model.net.counts)
    end = hot.index(b"") if hot else -1

    def flush(held: list[tuple]) -> pa.RecordBatch | None:
        docs = [d for x in held for d in x[0]]
        columns = [pa.concat_arrays([x[1][k] for x in held]) for k in range(8)]
        columns.insert(7, pa.array(net.score(docs) / np.log(10)) if end >= 0 else pa.array(np.zeros(len(docs))))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_tokens", "known", "base", "other", "other_base", "net", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for chunk in chunks(batches, "text"):
            found, rows = lowered(text_of(chunk, "text")), chunk.num_rows
            (ids, each), doc = numbered(hot).number(found), found.doc()
            by_doc = lambda flags, values=None: np.bincount(doc[flags], values, rows)
            is_hot, other = ids >= 0, (ids < 0) | (ids >= modelled)
            both = is_hot & other
            ends = logs[end] if end >= 0 else 0.0
            tail = tails(each, np.flatnonzero(~is_hot), doc, rows)
            numbers = [found.counts + 1, by_doc(is_hot) + (end >= 0), by_doc(is_hot, logs[ids[is_hot]]) + ends, by_doc(other), by_doc(both, logs[ids[both]])]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
            held.append((documents_of(found, ids, modelled, end), [chunk.column(0), chunk.column(1), *[pa.array(x.astype(k.to_pandas_dtype())) for x, k in zip(numbers, kinds, strict=True)], tail]))
            size += len(found.starts) + rows
            if size >= BUFFER:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def tails(each: pa.DictionaryArray, places: np.ndarray, doc: np.ndarray, rows: int) -> pa.Array:
    """For each text the words at ``places``, each once with its number there."""
    codes, kinds = each.indices.to_numpy()[places].astype(np.int64), max(1, len(each.dictionary))
    pairs, n = np.unique(doc[places] * kinds + codes, return_counts=True)
    offsets = np.searchsorted(pairs // kinds, np.arange(rows + 1)).astype(np.int32)
    listed = pa.StructArray.from_arrays([each.dictionary.take(pa.array(pairs % kinds)), pa.array(n.astype(np.int32))], names=["word", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), listed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row of docs (doc_id, text)."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("key"), docs["text"].alias("text"))
    scored = table(slim.mapInArrow(scorer(model), SCORED), "scored")
    tail = scored.select("key", F.explode("tail").alias("x")).select("key", "x.word", "x.n")
    sums = tail.join(model.counts, "word").groupBy("key").agg(F.sum("n").alias("known_"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("base_"))
    found = scored.drop("tail").join(sums, "key", "left")
    known, base = F.coalesce("known_", F.lit(0)), F.coalesce("base_", F.lit(0.0))
    n_rest, v_rest = model.rest
    per_token, per_other = float(np.log10(model.n + model.v + 1)), float(np.log10(n_rest + v_rest + 1))
    return found.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + known).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + base - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("net") + F.col("other_base") + base - F.col("other") * F.lit(per_other)).alias("score"),
    )
