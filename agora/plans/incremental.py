"""Merges, queues, budgets, change detection, and what remains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.operators import incremental as ops
from agora.plans.registry import query
from agora.sources.civic import Civic


@query("snk01_upsert", "SELECT COALESCE(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title FROM (SELECT id, title FROM {matters} WHERE id % 3 < 2) o FULL JOIN (SELECT id, upper(title) AS title FROM {matters} WHERE id % 3 > 0) n ON n.id = o.id")
def snk01(c: Civic) -> DataFrame:
    m = c.matters.select("id", "title")
    return ops.upsert(m.where("id % 3 < 2"), m.where("id % 3 > 0").withColumn("title", F.upper("title")), ["id"])


@query("snk01_insert_missing", "SELECT COALESCE(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.title ELSE n.title END AS title FROM (SELECT id, title FROM {matters} WHERE id % 3 < 2) o FULL JOIN (SELECT id, upper(title) AS title FROM {matters} WHERE id % 3 > 0) n ON n.id = o.id")
def snk01b(c: Civic) -> DataFrame:
    m = c.matters.select("id", "title")
    return ops.upsert(m.where("id % 3 < 2"), m.where("id % 3 > 0").withColumn("title", F.upper("title")), ["id"], update=False)


@query("snk02_bulk_update", "SELECT o.id, o.title, COALESCE(n.status, o.status) AS status FROM {matters} o LEFT JOIN (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE 'Archived' END AS status FROM {matters} WHERE id % 2 = 0) n ON n.id = o.id")
def snk02(c: Civic) -> DataFrame:
    changes = c.matters.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 != 0, "Archived").alias("status"))
    return ops.patched(c.matters.select("id", "title", "status"), changes, "id")


@query("snk03_replace_per_key", "SELECT person_id, motion_id, vote FROM {votes} WHERE person_id <> 5 UNION ALL SELECT person_id, motion_id, 'Redone' FROM {votes} WHERE person_id = 5 AND motion_id % 2 = 0")
def snk03(c: Civic) -> DataFrame:
    v = c.votes.select("person_id", "motion_id", "vote")
    return ops.replaced(v, v.where("person_id = 5 and motion_id % 2 = 0").withColumn("vote", F.lit("Redone")), "person_id")


@query("stm02_claim_job", "SELECT j.id, 'running' AS status, 'w1' AS worker, CAST(j.attempts + 1 AS BIGINT) AS attempts FROM {jobs} j WHERE status = 'queued' AND attempts < max_attempts AND kind IN (1, 2) AND NOT EXISTS (SELECT 1 FROM {jobs} r WHERE r.status = 'running' AND r.municipality_id = j.municipality_id AND r.source_id = j.source_id) ORDER BY priority DESC, requested_at, id LIMIT 3")
def stm02(c: Civic) -> DataFrame:
    return ops.claim(c.jobs, "w1", "2024-01-01 00:00:00", kinds=[1, 2], count=3).select("id", "status", "worker", F.col("attempts").cast("long").alias("attempts"))


@query("srt07_queue_order", "SELECT id FROM {jobs} WHERE status = 'queued' ORDER BY priority DESC, requested_at, id LIMIT 1")
def srt07(c: Civic) -> DataFrame:
    return c.jobs.where("status = 'queued'").orderBy(F.col("priority").desc(), "requested_at", "id").limit(1).select("id")


@query("stm03_changes", "SELECT COALESCE(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'gone' ELSE 'changed' END AS change FROM (SELECT id, title AS d FROM {matters} WHERE id % 5 > 0) a FULL JOIN (SELECT id, CASE WHEN id % 7 = 0 THEN 'x' ELSE title END AS d FROM {matters} WHERE id % 5 < 4) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.d IS DISTINCT FROM b.d")
def stm03(c: Civic) -> DataFrame:
    known = c.matters.where("id % 5 > 0").select("id", F.sha2("title", 256).alias("digest"))
    seen = c.matters.where("id % 5 < 4").select("id", F.sha2(F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("title")), 256).alias("digest"))
    return ops.changed(known, seen, "id", "digest")


@query("stm04_reingest_reasons", "SELECT id, concat_ws(',', CASE WHEN has_agenda IS NULL THEN 'agenda' END, CASE WHEN has_minutes AND summary IS NULL THEN 'minutes' END, CASE WHEN status = 'Planned' THEN 'status' END) AS reasons FROM {meetings} WHERE has_agenda IS NULL OR (has_minutes AND summary IS NULL) OR status = 'Planned'")
def stm04(c: Civic) -> DataFrame:
    tests = {"agenda": F.col("has_agenda").isNull(), "minutes": F.col("has_minutes") & F.col("summary").isNull(), "status": F.col("status") == "Planned"}
    return ops.reasons(c.meetings, tests).select("id", F.array_join("reasons", ",").alias("reasons"))


#: Calendar events on and off the days of meetings, of many bodies.
CALENDAR = "SELECT o_orderkey AS event_id, o_custkey % 997 AS organization_id, CAST(o_orderdate AS DATE) AS event_date, o_orderkey % 4 AS moved FROM {orders}"
BODIES = "SELECT o_orderkey AS id, o_custkey % 997 AS organization_id, CAST(o_orderdate AS DATE) AS meeting_date FROM {orders} WHERE o_orderkey % 9 <> 2"


@query("stm07_reconcile_calendar", f"""
    WITH e AS (SELECT event_id, organization_id, event_date + CAST(CASE moved WHEN 1 THEN 14 WHEN 2 THEN 15 WHEN 3 THEN 40 ELSE 0 END AS INT) AS event_date FROM ({CALENDAR})), m AS ({BODIES})
    SELECT e.event_id, CASE WHEN COUNT(m.id) = 1 THEN MIN(m.id) END AS meeting_id, CASE WHEN COUNT(m.id) = 1 THEN 'bound' WHEN COUNT(m.id) > 1 THEN 'held' ELSE 'created' END AS status
    FROM e LEFT JOIN m ON m.organization_id = e.organization_id AND ABS(e.event_date - m.meeting_date) <= 14 GROUP BY e.event_id""")
def stm07(c: Civic) -> DataFrame:
    shift = F.when(F.col("moved") == 1, 14).when(F.col("moved") == 2, 15).when(F.col("moved") == 3, 40).otherwise(0)
    events = c.spark.sql(CALENDAR, orders=c.orders).withColumn("event_date", F.date_add("event_date", shift))
    return ops.reconciled(events, c.spark.sql(BODIES, orders=c.orders), 14)


@query("stm08_compare_and_swap", """
    SELECT w.id, CASE WHEN w.id % 11 = 0 AND c.title = c.title THEN 'already_applied' WHEN w.id % 3 = 0 THEN 'conflict' WHEN c.hidden THEN 'protected' ELSE 'applied' END AS status FROM {matters} w JOIN {matters} c ON c.id = w.id""")
def stm08(c: Civic) -> DataFrame:
    current = c.matters.select("id", "title", F.col("hidden").alias("verified"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    writes = c.matters.select("id", F.when(F.col("id") % 3 == 0, "other").otherwise(F.col("title")).alias("expected"), F.upper("title").alias("title"), digest.alias("input_hash"))
    receipts = c.matters.where("id % 11 = 0").select(digest.alias("input_hash"), "title")
    return ops.compare_and_swap(current, writes, receipts, "id", "title")


@query("stm09_daily_budget", "SELECT event_id, n <= 100 AS allowed, GREATEST(0, 100 - n) AS remaining FROM (SELECT event_id, ROW_NUMBER() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM {events})")
def stm09(c: Civic) -> DataFrame:
    rows = ops.within_budget(c.events.withColumn("day", F.to_date("ts")), "day", ["ts", "event_id"], 100)
    return rows.select("event_id", "allowed", F.col("remaining").cast("long").alias("remaining"))


@query("stm10_fresh_answers", "SELECT event_id FROM {events} WHERE ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-25 00:00:00' AND ts > (SELECT MAX(ts) FROM {events} WHERE event_type = 'error' AND event_id < 5000)")
def stm10(c: Civic) -> DataFrame:
    cache = c.events.select("event_id", F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    last = c.events.where("event_type = 'error' and event_id < 5000").select(F.col("ts").alias("updated_at"))
    return ops.fresh_answers(cache, last, "2024-01-25 00:00:00").select("event_id")


@query("rem13_transition_check", "SELECT id, upper(title) AS expected, title AS actual FROM {matters} WHERE id % 9 = 0 AND upper(title) <> title")
def rem13(c: Civic) -> DataFrame:
    m = c.matters.select("id", "title")
    return ops.transition_errors(m, m.where("id % 9 = 0").withColumn("title", F.upper("title")), m, "id", "title")


@query("rem11_best_image", "SELECT o_custkey AS matter_id, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS image_id FROM {orders} WHERE o_totalprice >= 100000 GROUP BY o_custkey")
def rem11(c: Civic) -> DataFrame:
    return c.orders.where("o_totalprice >= 100000").groupBy(F.col("o_custkey").alias("matter_id")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("image_id"))


@query("rem10_image_candidates", "SELECT matter_id, id FROM (SELECT o_custkey % 100 AS matter_id, o_orderkey AS id, ROW_NUMBER() OVER (PARTITION BY o_custkey % 100 ORDER BY o_totalprice DESC, o_orderkey) AS k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey % 100, o_orderdate, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS d FROM {orders}) WHERE d = 1) WHERE k <= 24")
def rem10(c: Civic) -> DataFrame:
    from agora.operators.windows import first_of

    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    rows = c.orders.withColumn("matter_id", F.col("o_custkey") % 100)
    once = first_of(rows, ["matter_id", "o_orderdate", "o_orderpriority"], order).drop("place")
    return first_of(once, ["matter_id"], order, 24).select("matter_id", F.col("o_orderkey").alias("id"))


@query("rem12_claim_inventory", "SELECT meeting_id, COUNT(*) AS n, COUNT(DISTINCT id) = COUNT(*) AS unique_ids, sha256('[' || string_agg(CAST(id AS STRING), ',' ORDER BY id) || ']') AS fingerprint FROM {motions} GROUP BY meeting_id")
def rem12(c: Civic) -> DataFrame:
    return c.motions.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("id") == F.count(F.lit(1))).alias("unique_ids"), F.sha2(F.to_json(F.array_sort(F.collect_list("id"))), 256).alias("fingerprint"))


@query("rem24_glossary_harvest", "SELECT original, replacement, n FROM (SELECT p_name AS original, p_brand AS replacement, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY COUNT(*) DESC, p_brand) AS k FROM {part} WHERE len(string_split(p_name, ' ')) <= 3 AND ABS(length(p_name) - length(p_brand)) <= 5 GROUP BY 1, 2) WHERE k = 1 AND n >= 3")
def rem24(c: Civic) -> DataFrame:
    from agora.operators.windows import first_of

    pairs = c.part.where((F.size(F.split("p_name", " ")) <= 3) & (F.abs(F.length("p_name") - F.length("p_brand")) <= 5)).groupBy(F.col("p_name").alias("original"), F.col("p_brand").alias("replacement")).agg(F.count(F.lit(1)).alias("n"))
    return first_of(pairs, ["original"], [F.col("n").desc(), F.col("replacement")]).where("n >= 3").select("original", "replacement", "n")


@query("rem27_map_markers", "SELECT CAST(id AS STRING) || ':' || CAST(k AS STRING) AS key, lat FROM (SELECT c_custkey AS id, 0 AS k, c_acctbal / 50 AS lat FROM {customer} UNION ALL SELECT c_custkey, 1, c_acctbal / 100 FROM {customer}) WHERE isfinite(lat) AND ABS(lat) <= 85.051129")
def rem27(c: Civic) -> DataFrame:
    rows = c.customer.select("c_custkey", F.posexplode(F.array(F.col("c_acctbal") / 50, F.col("c_acctbal") / 100)).alias("k", "lat"))
    return rows.where("not isnan(lat) and abs(lat) <= 85.051129").select(F.concat_ws(":", F.col("c_custkey").cast("string"), F.col("k").cast("string")).alias("key"), "lat")


@query("rem29_election_results", "SELECT o_custkey AS office, o_orderkey AS candidate, ROUND(o_totalprice / SUM(o_totalprice) OVER (PARTITION BY o_custkey) * 100, 4) AS share, ROUND(o_totalprice / MAX(o_totalprice) OVER (PARTITION BY o_custkey) * 100, 4) AS bar, RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place FROM {orders}")
def rem29(c: Civic) -> DataFrame:
    w = Window.partitionBy("office")
    votes = F.col("o_totalprice")
    rows = c.orders.withColumn("office", F.col("o_custkey"))
    return rows.select("office", F.col("o_orderkey").alias("candidate"), F.round(votes / F.sum(votes).over(w) * 100, 4).alias("share"), F.round(votes / F.max(votes).over(w) * 100, 4).alias("bar"), F.rank().over(w.orderBy(votes.desc())).cast("long").alias("place"))


@query("rem32_dashboard", "SELECT status, COUNT(*) AS n FROM {jobs} GROUP BY status")
def rem32(c: Civic) -> DataFrame:
    return c.jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("rem35_last_source", "SELECT kind, source_id, MAX(id) AS id FROM {jobs} GROUP BY kind, source_id")
def rem35(c: Civic) -> DataFrame:
    return c.jobs.groupBy("kind", "source_id").agg(F.max_by("id", "id").alias("id"))


@query("rem36_match_reasons", "SELECT user_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (SELECT user_id, 'topic' AS reason FROM {subscriptions} WHERE is_active AND topic < 3 UNION ALL SELECT user_id, 'matter' FROM {subscriptions} WHERE is_active AND matter_id < 10 UNION ALL SELECT user_id, 'person' FROM {subscriptions} WHERE is_active AND person_id < 15) GROUP BY user_id")
def rem36(c: Civic) -> DataFrame:
    s = c.subscriptions.where("is_active")
    parts = [s.where(test).select("user_id", F.lit(name).alias("reason")) for name, test in (("topic", "topic < 3"), ("matter", "matter_id < 10"), ("person", "person_id < 15"))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query("rem39_backfill_missing", "SELECT id FROM {meetings} m WHERE has_transcript AND NOT EXISTS (SELECT 1 FROM {segments} s WHERE s.meeting_id = m.id)")
def rem39(c: Civic) -> DataFrame:
    return c.meetings.where("has_transcript").join(c.segments.select(F.col("meeting_id").alias("k")), F.col("id") == F.col("k"), "left_anti").select("id")


@query("ext02_tumbling_usage", "SELECT CAST(date_trunc('hour', ts) AS STRING) AS hour, event_type, COUNT(*) AS n, ROUND(SUM(CAST(value AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM {events} GROUP BY 1, 2")
def ext02(c: Civic) -> DataFrame:
    from agora.streaming.usage import hourly

    return hourly(c.events).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


#: Workers' messages about jobs: claims, heartbeats and ends of five workers, some of them long silent.
MESSAGES = "SELECT event_id, event_id % 211 AS job_id, ts, CASE CAST(FLOOR(event_id / 211) AS BIGINT) % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'heartbeat' WHEN 2 THEN CASE WHEN user_id % 3 = 0 THEN 'claim' ELSE 'heartbeat' END ELSE CASE user_id % 7 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'claim' ELSE 'heartbeat' END END AS event, 'w' || CAST(CASE WHEN user_id % 4 = 0 THEN user_id % 5 ELSE event_id % 211 % 5 END AS STRING) AS worker FROM {events}"


@query("stm01_leases", f"""
    WITH RECURSIVE m AS (SELECT *, epoch(ts) AS tm, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k FROM ({MESSAGES})),
    f AS (SELECT job_id, CAST(0 AS BIGINT) AS k, 'queued' AS status, CAST(NULL AS VARCHAR) AS holder, CAST(0 AS DOUBLE) AS until, 0 AS attempts, CAST(0 AS DOUBLE) AS tm, '' AS event, CAST(NULL AS VARCHAR) AS worker, '' AS outcome, false AS ran_out, '' AS left_as, CAST(NULL AS VARCHAR) AS lost, CAST(0 AS DOUBLE) AS ended FROM (SELECT DISTINCT job_id FROM m)
      UNION ALL SELECT job_id, k, CASE outcome WHEN 'claimed' THEN 'running' WHEN 'succeeded' THEN 'succeeded' WHEN 'failed' THEN 'failed' ELSE s END, CASE WHEN outcome = 'claimed' THEN w WHEN s <> 'running' AND outcome = 'refused' THEN NULL ELSE h END, CASE WHEN outcome IN ('claimed', 'kept') THEN tm + 86400 ELSE until END, attempts + CASE WHEN outcome = 'claimed' THEN 1 ELSE 0 END, tm, event, w, outcome, ran_out, s, lost, until
        FROM (SELECT x.*, CASE WHEN event = 'claim' THEN CASE WHEN s = 'queued' THEN 'claimed' ELSE 'refused' END WHEN s <> 'running' OR h <> w THEN 'refused' WHEN event = 'heartbeat' THEN 'kept' ELSE event END AS outcome
          FROM (SELECT m.job_id, m.k, m.tm, m.event, m.worker AS w, f.until, f.attempts, f.holder AS lost, f.status = 'running' AND m.tm > f.until AS ran_out, CASE WHEN f.status = 'running' AND m.tm > f.until THEN CASE WHEN f.attempts < 6 THEN 'queued' ELSE 'failed' END ELSE f.status END AS s, CASE WHEN f.status = 'running' AND m.tm > f.until THEN NULL ELSE f.holder END AS h FROM f JOIN m ON m.job_id = f.job_id AND m.k = f.k + 1) x))
    SELECT job_id, tm AS "at", event, worker, outcome, attempts FROM f WHERE k > 0 UNION ALL SELECT job_id, ended, 'expiry', lost, left_as, attempts - CASE WHEN outcome = 'claimed' THEN 1 ELSE 0 END FROM f WHERE ran_out""")
def stm01(c: Civic) -> DataFrame:
    from agora.streaming.leases import leases

    return leases(c.spark.sql(MESSAGES, events=c.events), length=86_400.0, most=6)
