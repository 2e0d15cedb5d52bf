"""Search: vector neighbours, full text with positions, reciprocal rank fusion and the boosts around it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.functions.stems import english_stem, stem
from agora.operators.joins import cosine, top_k

#: Words that the index leaves out.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
RRF_K, MOST = 50, 30


def tokens(text: Column) -> Column:
    """Lower-case words, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), 1)


def postings(docs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, term, positions of every stemmed word but the stop words; positions count all words, from 1."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    each = docs.select(F.col(key), F.posexplode(tokens(text)).alias("_at", "_word")).where(~F.col("_word").isin(STOP))
    return each.groupBy(key, stem(F.col("_word")).alias("term")).agg(F.array_sort(F.collect_list(F.col("_at") + 1)).alias("positions"))


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings as a table whose folders are buckets of terms, written once for all searches."""
    bucketed = index.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, terms: Sequence[str], buckets: int = 64) -> DataFrame:
    """The postings of some terms: of the folders only theirs are read, of those only the row groups that can have them."""
    wanted = spark.createDataFrame([(t,) for t in terms] or [("",)], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()
    return spark.read.parquet(path).where(F.col("bucket").isin([r[0] for r in wanted]) & F.col("term").isin(list(terms))).drop("bucket")


@dataclass
class Query:
    """A disjunction of conjunctions; each part is a phrase of one or more terms, wanted or not."""

    options: list[list[tuple[list[str], bool]]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return sorted({t for option in self.options for phrase, _ in option for t in phrase})


def web_query(text: str) -> Query:
    """Words are all wanted, "phrases" in order, or between alternatives, - before what isn't wanted."""
    options: list[list[tuple[list[str], bool]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text.lower()):
        if word == "or" and not minus:
            options.append([])
            continue
        terms = [english_stem(w) for w in re.findall(r"[^\W_]+", phrase or word) if w not in STOP]
        if terms:
            options[-1].append((terms, not minus))
    return Query([o for o in options if any(wanted for _, wanted in o)])


def has_phrase(terms: Sequence[str]) -> Column:
    """Whether the positions in ``places`` (a map of term to positions) hold the terms side by side."""
    first = F.col("places")[terms[0]]
    found = first.isNotNull()
    if len(terms) == 1:
        return found
    follow = F.exists(first, lambda p: _all_follow(terms, p))
    return F.coalesce(found & follow, F.lit(False))


def _all_follow(terms: Sequence[str], p: Column) -> Column:
    out = F.lit(True)
    for k, t in enumerate(terms[1:], 1):
        out &= F.coalesce(F.array_contains(F.col("places")[t], p + k), F.lit(False))
    return out


def matches(index: DataFrame, key: str, query: Query) -> DataFrame:
    """key and places of the documents that match; only the query's terms are read from the index."""
    own = index.where(F.col("term").isin(query.terms)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"))
    any_ = F.lit(False)
    for option in query.options:
        all_ = F.lit(True)
        for terms, wanted in option:
            all_ &= has_phrase(terms) if wanted else ~has_phrase(terms)
        any_ |= all_
    return own.where(any_)


#: Fixed value: the weight of a word in a text without marked parts.
WEIGHT = 0.1


def cover_density(positions: list[list[int]]) -> float:
    """The sum over all minimal stretches that hold every term (lists of positions): less the more other words they hold.

    A stretch counts a word's weight, divided by one more than the number of its words that are no terms.
    """
    events = sorted((p, k) for k, ps in enumerate(positions) for p in ps)
    last: dict[int, int] = {}
    total, before = 0.0, -1
    for n, (p, k) in enumerate(events):
        last[k] = n
        if len(last) == len(positions):
            first = min(last.values())
            if first > before:  # a stretch within which no shorter one ends
                total += WEIGHT / (1 + p - events[first][0] - (n - first))
                before = first
    return total


def text_rank(found: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """Adds rank, the cover density of the wanted terms that a document has."""
    known = F.array_compact(F.array(*[F.col("places")[t] for t in terms]))

    @F.pandas_udf("double")
    def density(column: pd.Series) -> pd.Series:
        return column.map(lambda ps: cover_density([list(p) for p in ps]) if len(ps) else 0.0)

    return found.select(key, density(known).alias("rank"))


def vector_match(vectors: DataFrame, query: Sequence[float], threshold: float, k: int) -> DataFrame:
    """vec_id, similarity of the k nearest vectors over a threshold; null and zero vectors never match."""
    return top_k(vectors, query, min(k, MOST), threshold).select("vec_id", "similarity")


def vector_search_all(vectors: DataFrame, tables: Sequence[tuple[str, DataFrame, int]], query: Sequence[float], threshold: float) -> DataFrame:
    """type, vec_id, similarity: the nearest rows of several tables (name, vec_ids, limit), each with a limit of its own."""
    found = [vector_match(vectors.join(rows, "vec_id", "left_semi"), query, threshold, k).select(F.lit(name).alias("type"), "vec_id", "similarity") for name, rows, k in tables]
    return reduce(DataFrame.unionByName, found)


def search_page(arms: Sequence[tuple[str, DataFrame]], page: int, size: int, most: int, top: float = 0.1, span: float = 0.09) -> DataFrame:
    """type, id, score of one page of several types' results (id, by), each cut to ``most`` and scored by its place.

    Scores fall from ``top`` by ``span`` over each type's results, so that the windows hold at most ``most`` rows.
    """
    scored = []
    for name, rows in arms:
        best = rows.orderBy(F.col("by").desc(), "id").limit(most)
        place, n = F.row_number().over(Window.orderBy(F.col("by").desc(), "id")), F.count(F.lit(1)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        scored.append(best.select(F.lit(name).alias("type"), "id", F.round(top - (place - 1) / n * span, 9).alias("score")))
    return reduce(DataFrame.unionByName, scored).orderBy(F.col("score").desc(), "type", "id").offset((page - 1) * size).limit(size)


def fused(text_arm: DataFrame, vector_arm: DataFrame, k: int, text_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two arms (id, score), each cut to twice the results wanted: id, score.

    Filters belong in the arms, since they change ranks. Each arm is limited before it is ranked, so that the windows
    over it hold at most 2 * MOST rows.
    """
    k = min(k, MOST)

    def ranked(arm: DataFrame, name: str) -> DataFrame:
        best = arm.orderBy(F.col("score").desc(), "id").limit(2 * k)
        return best.select(F.col("id").alias(f"{name}_id"), F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias(f"{name}_rank"))

    t, v = ranked(text_arm, "t"), ranked(vector_arm, "v")
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (RRF_K + F.col(rank)), F.lit(0.0))
    both = t.join(v, F.col("t_id") == F.col("v_id"), "full_outer")
    return both.select(F.coalesce("t_id", "v_id").alias("id"), (part("t_rank", text_weight) + part("v_rank", vector_weight)).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def speaker_search(segments: DataFrame, text: str, k: int) -> DataFrame:
    """id, score (0.05) of the first k segments of a speaker asked for by first and last name: the name, with an initial for
    the first, and both as they are listed of the public. Any other text finds nothing."""
    name = re.fullmatch(r"\s*([A-Za-z]+)\s+([A-Za-z][A-Za-z'-]+)\s*", text)
    forms = [f"{name[1]} {name[2]}", f"{name[1][0]}. {name[2]}"] if name else []
    aliases = [*forms, *(f"{x} (public)" for x in forms)]
    return segments.where(F.col("speaker_name").isin(aliases) if aliases else F.lit(False)).orderBy("start_time", "id").limit(k).select("id", F.lit(0.05).alias("score"))


def relevance(score: Column, day: Column, now: str, title: Column, text: str) -> Column:
    """A score raised for recent dates (0.6, halving by e every two years) and for titles that hold the query."""
    years = F.datediff(F.lit(now).cast("date"), day) / 365.25
    fresh = F.when(day.isNull(), 1.0).otherwise(1 + 0.6 * F.exp(-years / 2))
    named = F.when(F.lit(len(text) >= 3) & F.lower(title).contains(text.lower()), 1.3).otherwise(1.0)
    return score * fresh * named


def matter_score(terms: Sequence[str], title: Column, identifier: Column, rest: Column) -> Column:
    """Null unless every term is somewhere; 0.04, and more for a title, an identifier or other text with all of them."""
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    t, i, r = lower(title), lower(identifier), lower(rest)

    def every(text: Column) -> Column:
        out = F.lit(True)
        for x in terms:
            out &= text.contains(x.lower())
        return out

    whole = F.concat_ws(" ", t, i, r)
    return F.when(every(whole), 0.04 + F.when(every(t), 0.08).otherwise(0.0) + F.when(every(i), 0.08).otherwise(0.0) + F.when(every(r), 0.03).otherwise(0.0))


def centroid_audit(vectors: DataFrame, group: str) -> DataFrame:
    """vec_id, own and best other similarity of each vector to the groups' centroids, its own without itself.

    Sums of each group and dimension are aggregated, so that no group's vectors meet; groups are few.
    """
    each = vectors.select("vec_id", F.col(group).alias("g"), F.posexplode("embedding").alias("d", "x"))
    sums = each.groupBy("g", "d").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("v"), F.max("n").alias("n")).select(F.col("g").alias("c"), F.col("v.s").alias("sum"), "n")
    pairs = vectors.crossJoin(total)  # vectors times the few groups
    own = F.col(group) == F.col("c")
    rest = F.when(own, F.zip_with("sum", "embedding", lambda s, x: s - x.cast("double"))).otherwise(F.col("sum"))
    scored = pairs.where(~(own & (F.col("n") < 2))).withColumn("rest", rest).withColumn("similarity", cosine("embedding", "rest"))
    return scored.groupBy("vec_id").agg(F.max(F.when(own, F.col("similarity"))).alias("own"), F.max(F.when(~own, F.col("similarity"))).alias("other"))
