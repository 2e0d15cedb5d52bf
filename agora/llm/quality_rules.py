"""Learned decision lists over text statistics, applied as ordered Spark conditional expressions.

Sequential covering: a conjunction of thresholds is grown, one condition after the other by information gain, on two thirds
of the labelled documents not yet covered, then pruned back on the other third; it joins the list if it is right often
enough there, and what it covers is taken away. The list only names what to reject: a document that no rule covers is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.runtime import chunks, in_rows, text_of
from agora.llm.textkernel import exact_ids, window_ids, words

#: Labelled rows that a list is learned from at most, and thresholds tried per statistic.
ROWS, STEPS = 20_000, 64
#: A rule must be right so often on the rows that prune it, and cover so many of them.
PRECISION, LEAST = 0.95, 3
RULES, CONDITIONS = 12, 4
#: The characters that count as symbols, and the words of a repeated window.
SYMBOLS, WINDOW = b"#*$%&|<>", 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_marks", "n_distinct", "n_again"]
IS_SYMBOL, IS_UPPER, IS_MARK = (np.isin(np.arange(256), list(x)) for x in (SYMBOLS, bytes(range(65, 91)), b"!?"))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[bounds])


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which aren't a key's first occurrence."""
    _, first, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return count[back] > 1, later


def text_counts(texts: pa.Array) -> np.ndarray:
    """COUNTS of each text, in order."""
    w = words(texts)
    data, bounds = w.data, w.bounds
    n, total = len(bounds) - 1, len(w.starts)
    doc = w.doc()
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ids = exact_ids(data, w.starts, w.ends)
    at = np.arange(total)
    full = at + WINDOW <= w.first[1:][doc] if total else np.zeros(0, bool)
    start = at[full]
    again, _ = repeated(doc[start] * (total + 1) + window_ids(ids, start, WINDOW))
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, start[again], 1)
    np.add.at(marks, start[again] + WINDOW, -1)
    inside = np.cumsum(marks)[:total] > 0
    _, known = repeated(doc * (total + 1) + ids)
    same = np.zeros(total, bool)
    same[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    # Lines: stretches between breaks; only those with a word count.
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    stops = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(bounds, breaks, side="right") - 1]), kind="stable")
    worded = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, starts)
    starts, stops, line_doc = starts[worded], stops[worded], line_doc[worded]
    _, dup = repeated(line_doc * (len(starts) + 1) + exact_ids(data, starts, stops))
    size = heads[w.ends] - heads[w.starts]
    columns = [
        w.counts,
        per_text(size, w.first),
        per_text(IS_SYMBOL[data], bounds),
        np.bincount(line_doc[dup], minlength=n),
        per_text(inside, w.first),
        np.diff(heads[bounds]),
        per_text(IS_UPPER[data], bounds),
        per_text(IS_MARK[data], bounds),
        per_text(~known, w.first),
        per_text(same, w.first),
    ]
    return np.stack([np.asarray(c, np.int64) for c in columns], axis=1)


def statistics(docs: DataFrame) -> DataFrame:
    """row (the columns of ``docs``) and COUNTS for every row; null texts have none of anything."""
    rows = in_rows(docs)
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            made = text_counts(text_of(chunk, "text"))
            yield pa.RecordBatch.from_arrays([chunk.column(0), *(pa.array(x) for x in made.T)], names=schema.names)

    return rows.mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """The statistics that rules are about, of equal gain the earlier first; a text without words has 0 of each."""

    def share(of: str, by: str) -> Column:
        return F.coalesce(F.try_divide(F.col(of).cast("double"), F.col(by).cast("double")), F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "capitals": share("n_upper", "word_chars"),
        "same_as_before": share("n_again", "n_words"),
        "repeats": share("n_repeat_words", "n_words"),
        "distinct": share("n_distinct", "n_words"),
        "repeated_lines": F.col("n_dup_lines").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.limit if self.above else x[self.feature] <= self.limit


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(n, bool))


def grow(x: dict[str, np.ndarray], bad: np.ndarray, limits: dict[str, np.ndarray]) -> Rule:
    """Adds the condition of largest gain until only bad rows are covered, or none gains."""
    rule: Rule = ()
    on = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (on & ~bad).any():
        p0, n0 = (on & bad).sum(), (on & ~bad).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            own = values[on]
            order = np.argsort(own, kind="stable")
            is_bad = bad[on][order]
            ends = np.searchsorted(own[order], limits[name], side="right")
            p = np.concatenate([[0], np.cumsum(is_bad)])[ends]
            n = ends - p
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p0 / (p0 + n0))), 0.0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, above, float(limits[name][k])), float(g[k])
        if best is None:
            break
        # Half-way to the nearest value beyond, so that a rule doesn't cling to what the rows left happen to show.
        own = x[best.feature][on]
        low, high = own[own <= best.limit], own[own > best.limit]
        if len(low) and len(high):
            best = Condition(best.feature, best.above, float((low.max() + high.min()) / 2))
        rule += (best,)
        on &= best.holds(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that tells bad rows from others best, the shortest of equals."""

    def worth(k: int) -> float:
        on = covered(rule[:k], x, len(bad))
        p, n = (on & bad).sum(), (on & ~bad).sum()
        return float((p - n) / (p + n)) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def thresholds(values: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Quantiles of all values and of the bad rows', and the values at which either kind ends."""
    steps = np.linspace(0, 1, STEPS + 1)
    out = [np.quantile(v, steps) for v in (values, values[bad]) if len(v)]
    for a, b in ((values[bad], values[~bad]), (values[~bad], values[bad])):
        if len(a) and len(b):
            below = b[b < a.min()]
            out += [[a.max()], [below.max()] if len(below) else []]
    return np.unique(np.concatenate([np.asarray(v, float) for v in out])) if out else np.zeros(1)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 11) -> list[Rule]:
    """Rules for bad rows, in order."""
    rng = np.random.default_rng(seed)
    left, rules = np.arange(len(bad)), []
    while len(rules) < RULES and bad[left].any():
        turn = rng.permutation(len(left)) % 3 > 0
        teach, test = left[turn], left[~turn]
        rule = grow({k: v[teach] for k, v in x.items()}, bad[teach], {k: thresholds(v[teach], bad[teach]) for k, v in x.items()})
        if not rule:
            break
        rule = prune(rule, {k: v[test] for k, v in x.items()}, bad[test])
        on = covered(rule, {k: v[test] for k, v in x.items()}, len(test))
        if (on & bad[test]).sum() < max(LEAST, PRECISION * on.sum()):
            break
        rules.append(rule)
        left = left[~covered(rule, {k: v[left] for k, v in x.items()}, len(left))]
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """A list learned from at most ROWS labelled rows whose crc32(doc_id) mod 5 isn't 0; none without bad rows.

    Documents with contradicting labels are left out; a fixed number of counts per row comes to the driver.
    """
    learnable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.where(learnable & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("z")).where("q = z")
    sample = docs.sparkSession.createDataFrame(known.select("label_id", "q").orderBy(F.xxhash64("label_id"), "label_id").limit(ROWS).collect(), "label_id long, q int")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", "q", "text")
    named = features()
    rows = statistics(chosen).select(F.col("row.doc_id").alias("doc_id"), F.col("row.q").alias("q"), *(v.alias(k) for k, v in named.items())).toArrow().sort_by([("doc_id", "ascending")] + [(k, "ascending") for k in named])
    return learn({k: rows.column(k).to_numpy() for k in named}, rows.column("q").to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression over COUNTS: the first rule that holds rejects, else the text is kept."""
    named = features()

    def holds(c: Condition) -> Column:
        return named[c.feature] > c.limit if c.above else named[c.feature] <= c.limit

    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(reduce(lambda a, b: a & b, map(holds, rule)), F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """row, COUNTS, base_failed and kept for every row of ``docs``.

    The base rules come first: too few words, or over ``most_repeated`` percent of them in repeated windows. Null and
    empty texts fail them. Repeated rows and null ids are judged like others.
    """
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", base).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
