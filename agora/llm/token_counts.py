"""Token counts by the whole-token shortcut, and the pre-token cache that packing shares.

``Vocabulary`` proves, once for a vocabulary file, which of its strings the library encodes alone as exactly one
token. A text is cut into pre-tokens; those found among the proven strings are counted directly, and only the rest
are merged, each distinct one once while it stays in a bounded table. ``PreTokens`` does so for chunks of texts with
numpy: it cuts by classes of code points, finds pre-tokens by hash and compares them byte by byte with what it knows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.runtime import by_chunk, offsets_of, text_of
from agora.llm.textkernel import Memo, spread, stretch_hashes

#: Merged pre-tokens that a Python worker remembers; beyond it the cache starts anew (only speed depends on it).
CACHE_ENTRIES = 200_000
#: Slots of a worker's table, half of which fill before it starts anew (only speed depends on it).
SLOTS = 1 << 20
#: The white space and the pre-token pattern of byte-level BPE files that split by the usual pattern.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SHAPE = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{W}{L}{N}]+|[{W}]+(?![^{W}])|[{W}]+"
PRETOKEN = SHAPE.format(L=r"\p{L}", N=r"\p{N}", W=WHITE)
#: Texts of code points below this one are cut by the standard library's faster engine with listed classes.
LATIN = 0x250


def listed(kind: str) -> str:
    """The code points below LATIN of a general category, as a character class."""
    return "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c)).startswith(kind))


LATIN_PRETOKEN = re.compile(SHAPE.format(L=listed("L"), N=listed("N"), W=WHITE))
BEYOND_LATIN = re.compile(f"[^\\x00-\\u{LATIN - 1:04x}]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, inverted."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def parts(items: list, n: int) -> Iterator[list]:
    return (items[k : k + n] for k in range(0, len(items), n))


class Vocabulary:
    """A byte-level BPE file with its proven whole tokens and the cache of merged pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]
        if spec["normalizer"] or steps.get("type") != "ByteLevel" or steps["add_prefix_space"] or not steps.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level files with the usual pre-token pattern are supported")
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = {x["content"]: self.packed([x["id"]]) for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern = regex.compile(PRETOKEN)
        self.whole = self.prove(spec["model"]["vocab"])
        self.merged: dict[str, bytes] = {}
        self.merger = self.prove_merger(spec["model"]["vocab"], spec["model"]["merges"])
        space = next(c for c, b in byte_letters().items() if b == 32)
        self.spaced = np.zeros(1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]), bool)
        self.spaced[[i for token, i in spec["model"]["vocab"].items() if token.startswith(space)]] = True

    @staticmethod
    def packed(ids: Iterable[int]) -> bytes:
        return np.array(list(ids), "<u4").tobytes()

    def prove(self, vocab: dict[str, int]) -> dict[str, bytes]:
        """Vocabulary strings that are one pre-token and that the library encodes alone as that one token."""
        letters, texts = byte_letters(), {}
        for token, ident in vocab.items():
            if token in self.special:
                continue
            try:
                text = bytes(letters[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.pattern.findall(text) == [text]:
                texts[text] = ident
        names = list(texts)
        encoded = self.library.encode_batch_fast(names, add_special_tokens=False)
        return {text: self.packed(got.ids) for text, got in zip(names, encoded, strict=True) if got.ids == [texts[text]]}

    def prove_merger(self, vocab: dict[str, int], merges: list) -> "tiktoken.Encoding | None":
        """A faster merger with the same results, or None where that can't be proven.

        It merges whichever neighbours make the token of least id. If ids follow the order of the merges and every
        token's bytes alone merge into that token, then neighbours that cover just a token's bytes have come about as
        they would alone, so that they are the pair of its own merge: both mergers take the same steps.
        """
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in merges]
        rank = {pair: k for k, pair in enumerate(pairs)}
        letters = byte_letters()
        plain = [x for x in vocab if x not in self.special]
        if sorted(vocab[x] for x in plain) != list(range(len(plain))) or len(plain) != 256 + len(pairs) or any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
            return None
        for token in plain:
            at = list(token)
            while len(at) > 1:
                k = min((rank.get(pair, len(rank)), n) for n, pair in enumerate(zip(at, at[1:], strict=False)))
                if k[0] == len(rank):
                    return None
                at[k[1] : k[1] + 2] = [at[k[1]] + at[k[1] + 1]]
        ranks = {bytes(letters[c] for c in x): vocab[x] for x in plain}
        self.sizes = np.zeros(1 + max(ranks.values()), np.int64)
        for x, k in ranks.items():
            self.sizes[k] = len(x)
        return tiktoken.Encoding("proven", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def pretokens(self, text: str) -> list[str]:
        pattern = self.pattern if BEYOND_LATIN.search(text) else LATIN_PRETOKEN
        if self.cut is None or not any(s in text for s in self.special):
            return pattern.findall(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else pattern.findall(part)
        return out

    def learn(self, needed: set[str]) -> None:
        """Merges by the library whatever is neither whole nor special nor cached."""
        if len(self.merged) + len(needed) > CACHE_ENTRIES:
            self.merged = {}
        needed -= self.merged.keys()
        names = [x for x in needed if x not in self.whole and x not in self.special]
        spaced = [x for x in names if x[0] == " " and x[1:].isalpha()]
        for part in parts(spaced, 2_000):
            # Each is a space and letters, so that the library cuts their concatenation back into them, and a token
            # that begins with the space begins the next one.
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = [*np.flatnonzero(self.spaced[ids]).tolist(), len(ids)]
            raw = ids.tobytes()
            if len(at) == len(part) + 1:
                self.merged.update((x, raw[4 * a : 4 * b]) for x, a, b in zip(part, at, at[1:], strict=False))
        for part in parts([x for x in names if x not in self.merged], 20_000):
            self.merged.update(zip(part, (self.packed(x.ids) for x in self.library.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [self.pretokens(t) if t else [] for t in texts]
        self.learn({x for pre in cut for x in pre})
        whole, merged, special = self.whole, self.merged, self.special

        def of(x: str) -> bytes:
            got = whole.get(x)
            if got is None:
                got = merged.get(x)
            return special[x] if got is None else got

        for pre in cut:
            yield b"".join(map(of, pre))

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text: one for each proven pre-token, the merged length for the others."""
        cut = [self.pretokens(t) if t else [] for t in texts]
        whole = self.whole
        rest = [[x for x in pre if x not in whole] for pre in cut]
        self.learn({x for pre in rest for x in pre})
        merged, special = self.merged, self.special
        return [len(pre) - len(odd) + sum(len(special[x] if x in special else merged[x]) // 4 for x in odd) for pre, odd in zip(cut, rest, strict=True)]


LETTER, NUMBER, BLANK = 1, 2, 3


@cache
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space, or 0 for any other."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0xD800)) + "\0" * 0x800 + "".join(chr(c) for c in range(0xE000, 0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, f"[{WHITE}]+")):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    return out


def followed_by(cp: np.ndarray, at: np.ndarray, letters: str) -> np.ndarray:
    """Whether ``letters`` come right after each place."""
    out = np.ones(len(at), bool)
    for k, c in enumerate(letters, 1):
        out &= cp[np.minimum(at + k, len(cp) - 1)] == ord(c)
        out &= at + k < len(cp)
    return out


def pretoken_edges(cp: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where the pattern's pre-tokens begin in texts of code points that begin at ``heads``."""
    n = len(cp)
    kind = classes()[cp]
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    begins = head[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    # A run of white space is one pre-token but for its last character, if something follows it in the text; that one
    # begins the next pre-token if it is a space.
    before = np.zeros(n, bool)
    before[:-1] = blank[:-1] & ~blank[1:] & ~head[1:n]
    after_space = np.zeros(n, bool)
    after_space[1:] = before[:-1] & (cp[:-1] == 32)
    edge = (begins & ~after_space) | before
    # An apostrophe that begins a pre-token takes certain letters along.
    mark = np.flatnonzero(edge & (cp == 39))
    within = np.searchsorted(np.append(heads, n), mark, side="right")
    room = np.append(heads, n)[within] - mark - 1
    for letters in ("s", "t", "re", "ve", "m", "ll", "d"):
        at = mark[followed_by(cp, mark, letters) & (room >= len(letters))]
        edge[at + 1] = False
        end = at + 1 + len(letters)
        end = end[end < n]
        edge[end[(kind[end] == LETTER) & ~head[end]]] = True
    return edge


class PreTokens:
    """Ids of pre-tokens, for a whole chunk of texts at once.

    The proven whole tokens are entered first, each with its one id; a pre-token that isn't among them is merged when it
    is seen for the first time. Texts with special strings go to ``Vocabulary`` whole.
    """

    def __init__(self, vocabulary: Vocabulary, slots: int = SLOTS):
        self.vocabulary = vocabulary
        self.memo = Memo(slots, np.uint8, self.proven)

    def proven(self, memo: Memo) -> None:
        self.ids, self.used, self.n = np.zeros(1 << 16, "<u4"), 0, 0
        self.at, self.size = (np.zeros(memo.room // 2, np.int64) for _ in range(2))
        texts = pa.array(self.vocabulary.whole)
        data, edges = np.frombuffer(texts.buffers()[2], np.uint8), offsets_of(texts)
        h = stretch_hashes(data, edges[:-1], edges[1:], memo.turn)
        h[h == 0] = 1
        memo.enter(h, data, edges[:-1], edges[1:])
        self.keep(list(self.vocabulary.whole.values()))

    def keep(self, ids: list[bytes]) -> None:
        """The ids of the next pre-tokens."""
        size = np.array([len(x) // 4 for x in ids], np.int64)
        new, before = slice(self.n, self.n + len(ids)), self.used
        self.at[new], self.size[new] = before + np.cumsum(size) - size, size
        self.used += int(size.sum())
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids[:before], np.zeros(2 * self.used - before, "<u4")])
        self.ids[before : self.used] = np.frombuffer(b"".join(ids), "<u4")
        self.n += len(ids)

    @staticmethod
    def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, each pre-token's start (and the end of all), the index of each text's first pre-token."""
        ends = offsets_of(texts)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
        bounds = ends - ends[0]
        if not len(data):
            return data, np.zeros(1, np.int64), np.zeros(len(bounds), np.int64)
        if data.max() < 128:
            starts = np.flatnonzero(pretoken_edges(data, bounds[:-1][bounds[:-1] < len(data)]))
        else:
            cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            place = np.flatnonzero((data & 0xC0) != 0x80)
            heads = np.searchsorted(place, bounds[:-1][bounds[:-1] < len(data)])
            starts = place[pretoken_edges(cp, heads)]
        return data, np.append(starts, len(data)), np.searchsorted(starts, bounds)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each pre-token of ``texts``, and the index of each text's first one."""
        data, edges, first = self.cut(texts)

        def learn(starts: np.ndarray, ends: np.ndarray) -> None:
            raw = data.tobytes()
            for lo in range(0, len(starts), 20_000):
                self.keep(self.merge([raw[a:b] for a, b in zip(starts[lo : lo + 20_000].tolist(), ends[lo : lo + 20_000].tolist(), strict=True)]))

        return self.memo.find(data, edges[:-1], edges[1:], learn), first

    def merge(self, pretokens: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens that aren't whole tokens; those behind a space are cut apart again wherever they stand."""
        out: dict[int, bytes] = {}
        if self.vocabulary.merger is not None:
            spaced = [k for k, x in enumerate(pretokens) if x[0] == 32 and x.strip()]
            ids = self.vocabulary.merger.encode_to_numpy(b"".join([pretokens[k] for k in spaced]).decode(), disallowed_special=())
            ends = np.concatenate([[0], np.cumsum(self.vocabulary.sizes[ids])])
            edges = np.concatenate([[0], np.cumsum([len(pretokens[k]) for k in spaced])]).astype(np.int64)
            at = np.searchsorted(ends, edges)
            if np.array_equal(ends[at], edges):
                packed = ids.astype("<u4").tobytes()
                out = {k: packed[4 * a : 4 * b] for k, a, b in zip(spaced, at[:-1].tolist(), at[1:].tolist(), strict=True)}
        rest = [k for k in range(len(pretokens)) if k not in out]
        out.update(zip(rest, self.vocabulary.encode([pretokens[k].decode() for k in rest]), strict=True))
        return [out[k] for k in range(len(pretokens))]

    def plain(self, texts: pa.Array) -> np.ndarray:
        out = np.ones(len(texts), bool)
        for special in self.vocabulary.special:
            out &= ~np.asarray(pc.match_substring(texts, special).to_numpy(zero_copy_only=False), bool)
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: one for each proven pre-token, the merged length for the others."""
        plain = self.plain(texts)
        out = np.zeros(len(texts), np.int64)
        if plain.any():
            entry, first = self.find(texts if plain.all() else texts.filter(pa.array(plain)))
            sums = np.concatenate([[0], np.cumsum(self.size[entry])])
            out[plain] = np.diff(sums[first])
        if not plain.all():
            out[~plain] = self.vocabulary.count(texts.filter(pa.array(~plain)).to_pylist())
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        plain = self.plain(texts)
        ids, ends, k = np.zeros(0, "<u4"), np.zeros(1, np.int64), 0
        if plain.any():
            entry, first = self.find(texts if plain.all() else texts.filter(pa.array(plain)))
            size = self.size[entry]
            ids = self.ids[spread(self.at[entry], size)]
            ends = np.concatenate([[0], np.cumsum(size)])[first]
        for i, easy in enumerate(plain):
            if easy:
                yield ids[ends[k] : ends[k + 1]]
                k += 1
            else:
                yield np.frombuffer(next(iter(self.vocabulary.encode([texts[i].as_py()]))), "<u4")


@cache
def pretoken_table(path: str) -> PreTokens:
    """One per Python worker and file."""
    return PreTokens(Vocabulary(path))


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``, as the library counts whole texts.

    Nulls and empty texts have 0 bytes and 0 tokens; a null doc_id and repeated rows are passed on; other columns
    are ignored. ``vocab_path`` is a file that every executor has (a tokenizer package installed with Python).
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_of(chunk, "text")
        return pa.RecordBatch.from_arrays([chunk.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(pretoken_table(vocab_path).count(texts))], names=schema.names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_chunk("text", work), schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


assert sys.byteorder == "little"
