"""N-best segmentation over a SentencePiece model's pieces: forward Viterbi, then backward A-star.

The forward pass gives the best score of every prefix, which is the exact remaining cost for a search that goes backward
from the end; so A-star pops complete segmentations in order of score. A lattice falls apart wherever no piece holds two
neighbouring characters together; each part is searched once per worker while it is remembered, and a text's N best are
the N best choices among its parts. Every part but the N - 1 with the least loss between their best and second keeps its
best: another's change would lose at least as much as each of those N - 1 single changes.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.runtime import chunks, in_rows, offsets_of, text_of
from agora.llm.textkernel import Memo, spread

#: Slots of a worker's table of parts, half of which fill before it starts anew (only speed depends on it).
PART_SLOTS = 1 << 19
MARK = "▁"
#: Stands for that character where a text has it itself, which no text can contain.
LITERAL = "\ud800"
#: Fixed value: what a character without piece costs beyond the least score.
UNKNOWN = 10.0


class Spellings:
    """The bytes that each piece of a model stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        raw = [b"" if model.is_control(k) or model.is_unknown(k) else bytes([int(x[3:5], 16)]) if model.is_byte(k) else x.replace(MARK, " ").encode() for k, x in enumerate(self.names)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def text(self, ids: np.ndarray) -> bytes:
        """Decodes ids: pieces side by side, without the space that encoding put in front."""
        raw = self.raw[spread(self.raw_at[ids], self.raw_size[ids])].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


class Pieces(Spellings):
    """A model's pieces and scores, and the table of parts already searched."""

    def __init__(self, path: str, n: int):
        super().__init__(path)
        self.n, model = n, self.model
        plain = [k for k in range(len(self.names)) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.ids = {self.names[k]: k for k in plain}
        self.scores = {self.names[k]: model.get_score(k) for k in plain}
        self.unknown = min(self.scores.values()) - UNKNOWN
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if model.is_unknown(self.bytes[0]):
            raise ValueError(f"{path}: only models with byte fallback are supported")
        self.longest = max(map(len, self.ids))
        self.packed = [np.array([k], "<u4").tobytes() for k in range(len(self.names))]
        self.tree: dict[str, tuple[float, bytes]] = {x[:k]: (0.0, b"") for x in self.ids for k in range(1, len(x))}
        self.tree |= {x: (self.scores[x], self.packed[k]) for x, k in self.ids.items()}
        pairs = {(ord(x[k]) << 21) | ord(x[k + 1]) for x in self.ids for k in range(len(x) - 1)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.memo = Memo(PART_SLOTS, np.uint32, self.clear)

    def clear(self, memo: Memo) -> None:
        # Of each part the ids of its best segmentations, best first, and what each loses against the best.
        # They lie one after the other in ``pool``: a list of small objects would take several times the room.
        self.parts_known, self.pool, self.used = 0, np.zeros(1 << 16, "<u4"), 0
        self.way_at, self.way_size = np.zeros(memo.room // 2 * self.n, np.int64), np.zeros(memo.room // 2 * self.n, np.int32)
        self.score = np.zeros(memo.room // 2)
        self.losses = np.full((memo.room // 2, self.n), np.inf)

    def search(self, part: str) -> list[tuple[float, bytes]]:
        """The N best segmentations of a part with their scores, best first."""
        tree, end, longest = self.tree, len(part), self.longest
        best = [0.0] + [-np.inf] * end
        # Into each place: what the best way through the edge costs up to there, where it starts, its own cost, its ids.
        into: list[list[tuple[float, int, float, bytes]]] = [[] for _ in range(end + 1)]
        for i in range(end):
            here = best[i]
            single = False
            for j in range(i + 1, min(end, i + longest) + 1):
                known = tree.get(part[i:j])
                if known is None:
                    break
                score, ids = known
                if ids:
                    single = single or j == i + 1
                    total = here + score
                    into[j].append((total, i, score, ids))
                    if total > best[j]:
                        best[j] = total
            if not single:
                spelt = b"".join(self.packed[self.bytes[x]] for x in (MARK if part[i] == LITERAL else part[i]).encode())
                into[i + 1].append((here + self.unknown, i, self.unknown, spelt))
                best[i + 1] = max(best[i + 1], here + self.unknown)
        # Each open path stands for segmentations of its own, and its cost is that of the best of them: no more open paths
        # than segmentations still wanted need be kept.
        found: list[tuple[float, bytes]] = []
        open_: list = [(-best[end], 0, end, 0.0, None)]
        turn, room = 0, self.n
        while open_:
            cost, _, at, after, path = open_.pop(0)
            if not at:
                ids = []
                while path is not None:
                    ids.append(path[0])
                    path = path[1]
                found.append((-cost, b"".join(ids)))
                room -= 1
                if not room:
                    break
                continue
            for total, i, score, ids in into[at]:
                turn += 1
                cost = -total - after
                if len(open_) < room:
                    insort(open_, (cost, turn, i, score + after, (ids, path)))
                elif cost < open_[-1][0]:
                    open_.pop()
                    insort(open_, (cost, turn, i, score + after, (ids, path)))
        return found

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, each with the space that the model puts in front; each part's start, and the end of
        all; the index of each text's first part."""
        size = np.diff(offsets_of(texts)) > 0
        spaced = [MARK + t.replace(MARK, LITERAL).replace(" ", MARK) if t else "" for t in texts.to_pylist()]
        cp = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in spaced])])
        if not len(cp):
            return cp, np.zeros(1, np.int64), np.zeros(len(bounds), np.int64)
        pair = (cp[:-1].astype(np.int64) << 21) | cp[1:]
        at = np.searchsorted(self.pairs, pair)
        mark = np.ones(len(cp), bool)
        mark[1:] = self.pairs[np.minimum(at, len(self.pairs) - 1)] != pair
        mark[bounds[:-1][size]] = True
        starts = np.flatnonzero(mark)
        return cp, np.append(starts, len(cp)), np.searchsorted(starts, bounds)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each part, and the index of each text's first part."""
        cp, edges, first = self.parts(texts)

        def learn(starts: np.ndarray, ends: np.ndarray) -> None:
            text, ways = cp.tobytes().decode("utf-32-le", "surrogatepass"), []
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True), self.parts_known):
                found = self.search(text[a:b])
                self.score[k] = found[0][0]
                self.losses[k, : len(found)] = [found[0][0] - s for s, _ in found]
                ways += [x for _, x in found] + [b""] * (self.n - len(found))
            self.keep(ways)

        return self.memo.find(cp, edges[:-1], edges[1:], learn), first

    def keep(self, ways: list[bytes]) -> None:
        size, ids = np.array([len(x) // 4 for x in ways], np.int64), np.frombuffer(b"".join(ways), "<u4")
        new = slice(self.parts_known * self.n, self.parts_known * self.n + len(ways))
        self.way_at[new], self.way_size[new] = self.used + np.cumsum(size) - size, size
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used // 2 + 2 * len(ids), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used, self.parts_known = self.used + len(ids), self.parts_known + len(ways) // self.n

    def way(self, k: int) -> bytes:
        return self.pool[self.way_at[k] : self.way_at[k] + self.way_size[k]].tobytes()

    def segment(self, texts: pa.Array) -> Iterator[list[tuple[float, bytes]]]:
        """The N best of each text: score and ids, as little-endian unsigned 32-bit numbers."""
        entry, first = self.find(texts)
        score, loss = self.score[entry], self.losses[entry, min(1, self.n - 1)]
        size = self.way_size[entry * self.n].astype(np.int64)
        best = self.pool[spread(self.way_at[entry * self.n], size)]
        edges = np.concatenate([[0], np.cumsum(size)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            at, plain = int(edges[a]), best[edges[a] : edges[b]].tobytes()
            total = float(score[a:b].sum())
            own = loss[a:b]
            few = min(self.n - 1, b - a)
            open_ = np.argsort(own, kind="stable")[:few] if b - a <= 4 * self.n else few_least(own, few)
            open_ = [k for k in sorted(open_.tolist()) if own[k] < np.inf]
            ways = [[(lost, self.way(int(entry[a + k]) * self.n + c)) for c, lost in enumerate(self.losses[entry[a + k]].tolist()) if lost < np.inf] for k in open_]
            picks = heapq.nsmallest(self.n, product(*(range(len(w)) for w in ways)), key=lambda pick: (sum(w[c][0] for w, c in zip(ways, pick, strict=True)), pick))
            out = []
            for pick in picks:
                lost, done, ids = 0.0, 0, []
                for k, w, c in zip(open_, ways, pick, strict=True):
                    ids += [plain[done : 4 * (int(edges[a + k]) - at)], w[c][1]]
                    done = 4 * (int(edges[a + k + 1]) - at)
                    lost += w[c][0]
                out.append((total - lost, b"".join([*ids, plain[done:]])))
            yield out


def few_least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values, the earlier of equal ones."""
    if not n:
        return np.zeros(0, np.int64)
    limit = np.partition(values, n - 1)[n - 1]
    below = np.flatnonzero(values < limit)
    return np.concatenate([below, np.flatnonzero(values == limit)[: n - len(below)]])


@cache
def pieces(path: str, n: int) -> Pieces:
    """One per Python worker, file and N."""
    return Pieces(path, n)


@cache
def spellings(path: str) -> Spellings:
    return Spellings(path)


def segment(docs: DataFrame, model_path: str, n: int = 3) -> DataFrame:
    """row (the columns of ``docs``) and nbest, an array of up to ``n`` (score, ids), best first, for every row.

    Scores are sums of the model's piece scores, in a BPE model the negative ranks of its merges, so that the best are those
    of the least sum of ranks, not the model's own merging. ids are packed as little-endian unsigned 32-bit numbers; a
    character without piece is spelt in byte pieces, and so is U+2581, which stands for the space in pieces. Null and empty texts have one segmentation, of no pieces and score 0. Repeated
    rows and null ids are passed on; equal scores keep the order in which the search meets them.
    """
    rows = in_rows(docs)
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("nbest array<struct<score: double, ids: binary>>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", 500_000):
            found = list(pieces(model_path, n).segment(text_of(chunk, "text")))
            flat = [x for best in found for x in best]
            inner = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.float64()), pa.array([x[1] for x in flat], pa.binary())], names=["score", "ids"])
            edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.ListArray.from_arrays(edges, inner)], names=["row", "nbest"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """row (the columns of ``encoded``) and decoded, the text of its packed ``ids``; null ids give null, no ids the empty text.

    Ids of ``segment`` give back the text that it got. Repeated rows are decoded like others.
    """
    rows = encoded.select(F.struct(*[encoded[c] for c in encoded.columns]).alias("row"), encoded["ids"].alias("ids"))
    schema = T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spellings(model_path)
        for batch in batches:
            texts = [None if x is None else model.text(np.frombuffer(x, "<u4")).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    return rows.mapInArrow(run, schema)
