"""Who was in the room when a vote was taken, by times known only within bounds, and the ballots that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def presence_at(votes: DataFrame, roster: DataFrame, changes: DataFrame) -> DataFrame:
    """vote, person, state (present, absent, unknown) of everyone on a meeting's roster at each of its votes.

    votes: doc, vote, low, high. roster: doc, person, present (at the start; null: not known). changes: doc, person, low, high,
    present (after it). A change lies anywhere within its bounds, a vote within its own; one that ended by the vote's lower
    bound came before, one that begins at its upper bound or later comes after, any other may be either. The state is that
    of the last change before (by its end, then its beginning; of equals absence counts), else the roster's, unless a change
    that may be either would turn it. Changes of people who aren't on the roster don't count.

    Which changes may be either is the difference of two running counts, of those begun and of those ended: two sweeps over
    the sorted bounds of each person, no join of intervals.
    """
    pairs = votes.join(roster.select("doc", "person", F.col("present").alias("first")), "doc")
    at = ["doc", "person"]
    told = changes.join(roster.select(*at), at, "left_semi")

    def sweep(change_at: str, vote_at: str, changes_first: bool) -> DataFrame:
        here = told.select(*at, F.col(change_at).alias("t"), F.lit(0 if changes_first else 1).alias("turn"), F.col("low").alias("since"), "present", F.lit(None).cast(pairs.schema["vote"].dataType).alias("vote"))
        there = pairs.select(*at, F.col(vote_at).alias("t"), F.lit(1 if changes_first else 0).alias("turn"), F.lit(None).cast(told.schema["low"].dataType).alias("since"), F.lit(None).cast("boolean").alias("present"), "vote")
        order = Window.partitionBy(*at).orderBy("t", "turn", F.col("since").asc_nulls_last(), F.desc("present"))
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        count = lambda flag: F.sum(F.coalesce(flag.cast("int"), F.lit(0))).over(so_far)
        rows = here.unionByName(there).select(*at, "vote", F.last("present", ignorenulls=True).over(so_far).alias("last"), count(F.col("present")).alias("came"), count(~F.col("present")).alias("went"))
        return rows.where("vote is not null")

    ended = sweep("high", "low", True)
    begun = sweep("low", "high", False).select(*at, "vote", F.col("came").alias("may_come"), F.col("went").alias("may_go"))
    rows = pairs.join(ended, [*at, "vote"]).join(begun, [*at, "vote"])
    known = F.coalesce("last", "first")
    turned = F.when(known, F.col("may_go") > F.col("went")).otherwise(F.col("may_come") > F.col("came"))
    state = F.when(known.isNull() | turned, "unknown").when(known, "present").otherwise("absent")
    return rows.select("doc", "vote", "person", state.alias("state"))


#: Outcomes that are decisions; the fewest appointed members and the most members of all that make a meeting.
DECISIONS = ["passed", "failed"]
QUORUM, SEATS = 5, 10


def committee_ballots(motions: DataFrame, members: DataFrame, states: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per motion: vote, status, yes, no; and the ballots (vote, person, choice, evidence) of those that can be told.

    motions: doc, vote, outcome, unanimous, rule (whether the rule that only dissent is recorded was in force), threshold (a
    special one). members: doc, person, role (councillor, citizen, mayor, visitor, unknown), proven (the office), chair. states:
    of ``presence_at``. named: vote, person, choice.

    Visitors don't vote. The first reason that holds a motion back is its status; a ballot needs a decision, proven offices
    and identities, a known state of every member, a quorum of appointed members with a chair among them, named choices of
    present members that agree with each other and with unanimity, a rule for those who aren't named, and a tally that gives
    the outcome.
    """
    m = members.select("doc", "person", "role", F.coalesce("proven", F.lit(False)).alias("proven"), F.coalesce("chair", F.lit(False)).alias("chair"))
    each = motions.select("doc", "vote").join(m, "doc").join(states.select("vote", "person", "state"), ["vote", "person"], "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
    choices = named.groupBy("vote", "person").agg(F.countDistinct("choice").alias("_kinds"), F.min("choice").alias("choice"))
    each = each.join(choices, ["vote", "person"], "left")
    here, votes = F.col("state") == "present", F.col("role").isin("councillor", "citizen", "mayor")
    any_ = lambda flag: F.coalesce(F.bool_or(flag), F.lit(False))
    choice = F.coalesce("choice", F.lit("Yes"))
    per = each.groupBy("vote").agg(
        any_((F.col("role") == "councillor") & ~F.col("proven")).alias("_office"),
        any_((F.col("role") == "mayor") & ~F.col("proven")).alias("_mayor"),
        any_((F.col("role") == "unknown") & (F.col("state") != "absent")).alias("_identity"),
        any_(votes & (F.col("state") == "unknown")).alias("_unknown"),
        F.count_if(here & votes).alias("_present"),
        F.count_if(here & votes & (F.col("role") != "mayor")).alias("_appointed"),
        any_(here & (F.col("role") == "councillor") & F.col("chair")).alias("_chair"),
        any_(F.col("_kinds").isNotNull() & ~(here & votes)).alias("_away"),
        any_(F.col("_kinds") > 1).alias("_both"),
        any_(F.col("_kinds").isNotNull() & ~F.coalesce(F.col("choice").isin("Yes", "No"), F.lit(False))).alias("_special"),
        any_(here & votes & (F.col("choice") == "No")).alias("_against"),
        F.count_if(here & votes & F.col("_kinds").isNotNull()).alias("_named"),
        F.count_if(here & votes & (choice == "Yes")).alias("yes"),
        F.count_if(here & votes & (choice == "No")).alias("no"),
    )
    strangers = named.select("vote", "person").distinct().join(each.select("vote", "person"), ["vote", "person"], "left_anti").select("vote").distinct().withColumn("_stranger", F.lit(True))
    rows = motions.join(per, "vote", "left").join(strangers, "vote", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    complete, sure = F.col("_named") == F.col("_present"), flag(F.col("unanimous"))
    status = (
        F.when(~flag(F.col("outcome").isin(DECISIONS)), "not_a_yes_no_decision")
        .when(F.col("_present").isNull(), "committee_full_identity_not_proven")
        .when(F.col("_office"), "committee_councillor_office_not_proven")
        .when(F.col("_mayor"), "committee_exofficio_mayor_not_proven")
        .when(F.col("_identity"), "committee_full_identity_not_proven")
        .when(F.col("_unknown"), "initial_presence_unknown")
        .when((F.col("_appointed") < QUORUM) | (F.col("_present") > SEATS) | ~F.col("_chair"), "committee_quorum_or_chair_not_proven")
        .when(flag(F.col("_stranger")), "unresolved_dissent_names")
        .when(F.col("_away"), "named_choice_voter_not_present")
        .when(F.col("_both"), "conflicting_named_source_choices")
        .when(F.col("_special"), "special_vote_or_recusal_needs_scope")
        .when(sure & F.col("_against"), "unanimous_result_conflicts_with_named_choice")
        .when(~complete & ~sure & ~flag(F.col("rule")), "recording_rule_not_refreshed")
        .when(flag(F.col("threshold")), "special_voting_threshold_needs_validation")
        .when((F.col("outcome") == "passed") != (F.col("yes") > F.col("no")), "reconstructed_tally_conflicts_with_outcome")
        .otherwise("reconstructable_candidate")
    )
    told = rows.select("vote", status.alias("status"), "yes", "no", complete.alias("_complete"), sure.alias("_sure"))
    good = F.col("status") == "reconstructable_candidate"
    evidence = F.when(F.col("_kinds").isNotNull(), "explicit_named").when(F.col("_sure"), "inferred_explicit_unanimity").otherwise("inferred_official_dissent_recording_rule")
    ballots = each.where(here & votes).join(told.where(good).select("vote", "_sure"), "vote").select("vote", "person", choice.alias("choice"), evidence.alias("evidence"))
    return told.select("vote", "status", F.when(good, F.col("yes")).alias("yes"), F.when(good, F.col("no")).alias("no")), ballots
