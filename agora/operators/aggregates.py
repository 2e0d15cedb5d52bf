"""Aggregates over meetings, speech, votes, attendance, usage and matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import topic

#: Results that count as carried or defeated in meeting statistics.
CARRIED = ["CARRIED", "CARRIED AS AMENDED", "AMENDED", "CARRRIED"]
DEFEATED = ["DEFEATED", "FAILED", "FAILED FOR LACK OF A SECONDER", "FAILED FOR LACK OF SECONDER", "NOT CARRIED"]
YES, NO = ["Yes", "In Favour"], ["No", "Opposed"]


def n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def meeting_stats(meetings: DataFrame, motions: DataFrame, items: DataFrame) -> DataFrame:
    """Per meeting the motions carried, defeated and other (no result included) and the topics of its items but General.

    Motions and items are aggregated before they join, so that neither multiplies the other.
    """
    result = F.upper("result")
    counted = motions.groupBy(F.col("meeting_id").alias("_m")).agg(n(result.isin(CARRIED)).alias("carried"), n(result.isin(DEFEATED)).alias("defeated"), F.count_if(~F.coalesce(result.isin(CARRIED + DEFEATED), F.lit(False))).alias("other"))
    named = topic("category")
    topics = items.groupBy(F.col("meeting_id").alias("_t")).agg(F.array_sort(F.collect_set(F.when(named != "General", named))).alias("topics"))
    out = meetings.join(counted, F.col("id") == F.col("_m"), "left").join(topics, F.col("id") == F.col("_t"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*meetings.columns, zero("carried"), zero("defeated"), zero("other"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


def speaking_time(segments: DataFrame, by: list[str]) -> DataFrame:
    """Seconds to a tenth, meetings and segments of each group; raw_seconds to order by."""
    seconds = F.sum((F.col("end_time") - F.col("start_time")).cast("decimal(18,3)"))  # exact, so that halves round alike
    return segments.groupBy(*by).agg(F.round(seconds, 1).cast("double").alias("seconds"), F.countDistinct("meeting_id").alias("meetings"), F.count(F.lit(1)).alias("segments"), seconds.alias("raw_seconds"))


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key and exact interpolated percentiles, each named. Values are counted before they meet, and a group's distinct values
    are run through in order, never held at once."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    totals = counts.groupBy(F.col(key).alias("_key")).agg(F.sum("_n").alias("_all"))
    ranked = counts.withColumn("_upto", upto).join(totals, F.col(key) == F.col("_key"))
    at = lambda share: share * (F.col("_all") - 1)
    first = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    bounds = ranked.groupBy(key, "_all").agg(*(f(F.floor(at(x)) if k == "low" else F.ceil(at(x))).alias(f"_{k}_{name}") for name, x in shares.items() for k, f in (("low", first), ("high", first))))
    between = lambda name, x: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (at(x) - F.floor(at(x)))
    return bounds.select(key, *(between(name, x).alias(name) for name, x in shares.items()))


def usage_summary(usage: DataFrame) -> DataFrame:
    """Per stage: calls, failures, tokens, exact interpolated latency percentiles, and its models with their calls."""
    models = usage.groupBy("stage", "model").agg(F.count(F.lit(1)).alias("calls")).groupBy(F.col("stage").alias("_s")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("model", "calls")))).alias("by_model"))
    total = usage.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), n(~F.col("ok")).alias("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return total.join(percentiles(usage, "stage", "latency", {"p50": 0.5, "p95": 0.95}), "stage", "left").join(models, F.col("stage") == F.col("_s")).drop("_s")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per stage by price per million tokens; a model without price makes the sum partial.

    ``prices`` (model, price_in, price_out) is a configuration table; Spark broadcasts it by its size.
    """
    p = prices.select(F.col("model").alias("_model"), "price_in", "price_out")
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return usage.join(p, F.col("model") == F.col("_model"), "left").groupBy("stage").agg(F.round(F.sum(cost), 6).alias("cost"), F.bool_or(F.col("_model").isNull()).alias("partial"))


def tallies(votes: DataFrame) -> DataFrame:
    """Yes, no and other votes of each motion."""
    return votes.groupBy("motion_id").agg(n(F.col("vote").isin(YES)).alias("yes"), n(F.col("vote").isin(NO)).alias("no"), n(~F.col("vote").isin(YES + NO)).alias("other"))


def complete_counts(votes: DataFrame, motions: DataFrame) -> DataFrame:
    """yes and no of motions with a complete roll call of distinct voters who all said yes or no; else null."""
    g = votes.groupBy(F.col("motion_id").alias("_m")).agg(n(F.col("vote") == "Yes").alias("y"), n(F.col("vote") == "No").alias("n"), F.count(F.lit(1)).alias("c"), F.countDistinct("person_id").alias("d"), F.bool_and(F.col("vote").isin("Yes", "No") & (F.col("person_id") >= 0)).alias("fit"))
    good = F.col("coverage").eqNullSafe("reconstructed_complete") & F.col("fit") & (F.col("c") == F.col("d"))
    return motions.join(g, F.col("id") == F.col("_m"), "left").select("id", F.when(good, F.col("y")).alias("yes"), F.when(good, F.col("n")).alias("no"))


def divided(votes: DataFrame, people: DataFrame) -> DataFrame:
    """Names for and against of the motions that someone opposed."""
    named = votes.join(people.select(F.col("id").alias("_p"), "name"), F.col("person_id") == F.col("_p"))
    names = lambda kinds: F.array_sort(F.collect_list(F.when(F.col("vote").isin(kinds), F.col("name"))))
    return named.groupBy("motion_id").agg(names(YES).alias("yes_names"), names(NO).alias("no_names")).where(F.size("no_names") > 0)


def service_periods(memberships: DataFrame, as_of: str, gap_days: int = 1) -> DataFrame:
    """Adjacent intervals of a person in an organisation as one period, with its status on a day.

    An open end reaches to the end of time; intervals touch if at most ``gap_days`` lie between.
    """
    end = F.coalesce("end_date", F.lit("9999-12-31").cast("date"))
    order = Window.partitionBy("person_id", "organization_id").orderBy("start_date", end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = memberships.withColumn("_end", end).withColumn("_new", F.when(F.col("start_date") <= F.date_add(reach, gap_days), 0).otherwise(1))
    rows = rows.withColumn("_period", F.sum("_new").over(order))
    merged = rows.groupBy("person_id", "organization_id", "_period").agg(F.min("start_date").alias("start_date"), F.max("_end").alias("_end"))
    day = F.lit(as_of).cast("date")
    status = F.when(F.col("start_date") > day, "upcoming").when(F.col("_end") < day, "past").otherwise("current")
    return merged.select("person_id", "organization_id", "start_date", F.when(F.col("_end") < F.lit("9999-12-31"), F.col("_end")).alias("end_date"), status.alias("status"))


def covered_seconds(intervals: DataFrame, by: list[str], start: str = "start_time", end: str = "end_time") -> DataFrame:
    """The length of the union of each group's intervals: what each adds beyond the furthest end before it."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return intervals.withColumn("_added", added).groupBy(*by).agg(F.sum("_added").alias("covered"))


def attendance(people: DataFrame, terms: DataFrame, meetings: DataFrame, memberships: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """Per person and term, and over all terms: meetings expected, attended, absent and unknown; the rate.

    A meeting is expected of those who serve its organisation on its day. Its state is the only one that the records
    (meeting_id, person_id, state, verified) give, else unknown. The rate is of whole percents and null where unknown
    meetings remain, unless more was recorded than verified. People and terms form a full matrix.
    """
    day = F.lit(as_of).cast("date")
    held = meetings.where((F.col("meeting_date") <= day) & (F.coalesce(F.lower("status"), F.lit("")).isin("cancelled", "canceled") == F.lit(False))).where(F.col("has_agenda").eqNullSafe(True) | F.col("has_minutes").eqNullSafe(True) | F.col("has_transcript").eqNullSafe(True) | F.col("summary").isNotNull())
    # Service without overlaps: what counts of a day's meetings counts once.
    served = service_periods(memberships.withColumn("start_date", F.coalesce("start_date", F.lit("0001-01-01").cast("date"))), as_of).select(F.col("person_id").alias("_person"), F.col("organization_id").alias("_o"), F.col("start_date").alias("_s"), F.coalesce("end_date", F.lit("9999-12-31").cast("date")).alias("_e"))
    serving = lambda rows: rows.join(served, (F.col("organization_id") == F.col("_o")) & F.col("meeting_date").between(F.col("_s"), F.col("_e")))
    t = terms.select(F.col("id").cast("string").alias("_term"), F.col("start_date").alias("_from"), F.coalesce("end_date", day).alias("_to"))

    def by_term(rows: DataFrame) -> DataFrame:
        dated = rows.join(F.broadcast(t), F.col("meeting_date").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")  # terms: a few rows
        return dated.unionByName(rows.withColumn("_term", F.lit("all")))

    # Members meet days with their numbers of meetings; only what was recorded is looked up by meeting.
    daily = held.groupBy("organization_id", "meeting_date").agg(F.count(F.lit(1)).alias("_n"))
    totals = by_term(serving(daily)).groupBy("_person", "_term").agg(F.sum("_n").alias("total"))
    states = records.groupBy(F.col("meeting_id").alias("_m"), F.col("person_id").alias("_p")).agg(F.when(F.min("state") == F.max("state"), F.min("state")).otherwise("unknown").alias("state"), F.bool_or("verified").alias("verified"))
    known = states.where(F.col("state").isin("present", "absent")).join(held.select(F.col("id").alias("_m"), "organization_id", "meeting_date"), "_m")
    known = known.join(served, (F.col("_p") == F.col("_person")) & (F.col("organization_id") == F.col("_o")) & F.col("meeting_date").between(F.col("_s"), F.col("_e")))
    seen = by_term(known.select("_person", "meeting_date", "state", F.coalesce("verified", F.lit(False)).alias("verified"))).groupBy(F.col("_person").alias("_q"), F.col("_term").alias("_u")).agg(n(F.col("state") == "present").alias("attended"), n(F.col("state") == "absent").alias("absent"), n(F.col("verified")).alias("verified"))
    counts = totals.join(seen, (F.col("_person") == F.col("_q")) & (F.col("_term") == F.col("_u")), "left").fillna(0, ["attended", "absent", "verified"])
    periods = t.select(F.col("_term").alias("term")).unionByName(people.sparkSession.createDataFrame([("all",)], "term string"))
    matrix = people.select(F.col("id").alias("person_id")).crossJoin(F.broadcast(periods))  # people times a few terms
    out = matrix.join(counts, (F.col("person_id") == F.col("_person")) & (F.col("term") == F.col("_term")), "left").fillna(0, ["total", "attended", "absent", "verified"])
    unknown, recorded = F.col("total") - F.col("attended") - F.col("absent"), F.col("attended") + F.col("absent")
    rate = F.when((F.col("total") > 0) & ((unknown == 0) | (recorded > F.col("verified"))), F.round(100 * F.col("attended") / F.col("total")).cast("long"))
    return out.select("person_id", "term", "total", "attended", "absent", unknown.alias("unknown"), "verified", recorded.alias("recorded"), rate.alias("rate"))
