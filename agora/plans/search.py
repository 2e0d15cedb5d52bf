"""Vector, text and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import joins, vectors
from agora.operators import search as ops
from agora.plans.registry import query
from agora.sources.civic import Civic

COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
SIM = COS.replace("{a}", "e.embedding").replace("{b}", "q.embedding")
Q0 = "(SELECT embedding FROM {embeddings} WHERE vec_id = 0) q"


def vector(c: Civic, vec_id: int = 0) -> list[float]:
    return list(c.embeddings.where(F.col("vec_id") == vec_id).first()["embedding"])


@query("vec01_cosine", f"SELECT e.vec_id, ROUND({SIM}, 6) AS similarity FROM {{embeddings}} e, {Q0}")
def vec01(c: Civic) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in vector(c)])
    return c.embeddings.withColumn("q", q).select("vec_id", F.round(joins.cosine("embedding", "q"), 6).alias("similarity"))


@query("vec02_match_motions", f"SELECT m.id, ROUND({SIM}, 5) AS similarity FROM {{embeddings}} e JOIN {{motions}} m ON m.id = e.vec_id, {Q0} WHERE {SIM} > 0.05 AND m.disposition <> 'Procedural' ORDER BY {SIM} DESC, m.id LIMIT 20")
def vec02(c: Civic) -> DataFrame:
    rows = c.embeddings.join(c.motions.where("disposition <> 'Procedural'").select("id"), F.col("vec_id") == F.col("id"))
    return ops.vector_match(rows, vector(c), 0.05, 20).select(F.col("vec_id").alias("id"), F.round("similarity", 5).alias("similarity"))


@query("vec03_match_matters", f"SELECT m.id, m.title, ROUND({SIM}, 5) AS similarity FROM {{embeddings}} e JOIN {{matters}} m ON m.id = e.vec_id, {Q0} WHERE {SIM} > 0.1 AND m.municipality_id = 1 ORDER BY {SIM} DESC, m.id LIMIT 10")
def vec03(c: Civic) -> DataFrame:
    rows = c.embeddings.join(c.matters.where("municipality_id = 1").select("id"), F.col("vec_id") == F.col("id"))
    best = ops.vector_match(rows, vector(c), 0.1, 10)
    return best.join(c.matters.select("id", "title"), F.col("vec_id") == F.col("id")).select("id", "title", F.round("similarity", 5).alias("similarity"))


@query("vec06_match_chunks_of", f"SELECT e.vec_id, ROUND({SIM}, 5) AS similarity FROM {{embeddings}} e, {Q0} WHERE e.label = 2 AND {SIM} > 0.0 ORDER BY {SIM} DESC, e.vec_id LIMIT 30")
def vec06(c: Civic) -> DataFrame:
    return ops.vector_match(c.embeddings.where("label = 2"), vector(c), 0.0, 100).withColumn("similarity", F.round("similarity", 5))


@query("vec08_match_by_person", f"SELECT e.vec_id, v.vote, ROUND({SIM}, 5) AS similarity FROM {{embeddings}} e JOIN {{votes}} v ON v.motion_id = e.vec_id AND v.person_id = 9, {Q0} ORDER BY {SIM} DESC, e.vec_id LIMIT 15")
def vec08(c: Civic) -> DataFrame:
    mine = c.votes.where("person_id = 9").select("motion_id", "vote")
    rows = c.embeddings.join(mine, F.col("vec_id") == F.col("motion_id"))
    return joins.top_k(rows, vector(c), 15).select("vec_id", "vote", F.round("similarity", 5).alias("similarity"))


@query("vec10_best_voice", f"SELECT q.vec_id, arg_max(e.vec_id, ({SIM}, -e.vec_id)) AS best FROM {{embeddings}} q JOIN {{embeddings}} e ON e.label = q.label AND e.vec_id % 2 = 0 AND q.vec_id % 2 = 1 WHERE {SIM} > 0.1 GROUP BY q.vec_id")
def vec10(c: Civic) -> DataFrame:
    found = vectors.similar(c.embeddings.where("vec_id % 2 = 1"), c.embeddings.where("vec_id % 2 = 0"), "label", 0.1, k=1)
    return found.select(F.col("q_id").alias("vec_id"), F.col("vec_id").alias("best"))


@query("vec11_centroid_audit", """
    WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS d FROM {embeddings}),
    s AS (SELECT label, d, SUM(v) AS s, COUNT(*) AS n FROM x GROUP BY 1, 2),
    p AS (SELECT x.vec_id, x.label AS mine, s.label AS c, CASE WHEN x.label = s.label THEN s.s - x.v ELSE s.s END AS r, x.v, s.n FROM x JOIN s ON s.d = x.d),
    q AS (SELECT vec_id, mine, c, SUM(r * v) / (SQRT(SUM(r * r)) * SQRT(SUM(v * v))) AS sim FROM p WHERE NOT (mine = c AND n < 2) GROUP BY 1, 2, 3),
    m AS (SELECT vec_id, MAX(sim) FILTER (mine = c) AS own, MAX(sim) FILTER (mine <> c) AS other FROM q GROUP BY 1)
    SELECT vec_id, ROUND(own, 5) AS own, ROUND(other, 5) AS other, own < other AS closer_elsewhere FROM m""")
def vec11(c: Civic) -> DataFrame:
    return ops.centroid_audit(c.embeddings, "label").select("vec_id", F.round("own", 5).alias("own"), F.round("other", 5).alias("other"), (F.col("own") < F.col("other")).alias("closer_elsewhere"))


@query("vec12_neighbour_links", f"""
    WITH y AS (SELECT vec_id, embedding, label, CAST(vec_id % 12 AS INT) AS year FROM {{embeddings}}),
    s AS (SELECT q.vec_id AS q_id, e.vec_id, {SIM} AS similarity FROM y q JOIN y e ON e.label = q.label AND e.vec_id <> q.vec_id AND ABS(e.year - q.year) <= 4),
    b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY q_id ORDER BY similarity DESC, vec_id) AS k FROM s WHERE similarity >= 0.1)
    SELECT LEAST(q_id, vec_id) AS a, GREATEST(q_id, vec_id) AS b, ROUND(MAX(similarity), 5) AS similarity FROM b WHERE k <= 3 GROUP BY 1, 2""")
def vec12(c: Civic) -> DataFrame:
    rows = c.embeddings.withColumn("year", (F.col("vec_id") % 12).cast("int"))
    return vectors.nearest_links(rows, "label", "year", 3, 0.1, 4).withColumn("similarity", F.round("similarity", 5))


@query("vec13_max_pooling", f"SELECT e.vec_id % 50 AS item, q.vec_id % 50 AS matter, ROUND(MAX({SIM}), 5) AS similarity FROM {{embeddings}} e JOIN {{embeddings}} q ON e.label = q.label WHERE q.vec_id % 2 = 1 AND e.vec_id % 2 = 0 GROUP BY 1, 2")
def vec13(c: Civic) -> DataFrame:
    rows = c.embeddings.withColumn("part", F.col("vec_id") % 50)
    found = vectors.pooled(rows.where("vec_id % 2 = 1"), rows.where("vec_id % 2 = 0"), "label", "part")
    return found.select(F.col("group").alias("item"), F.col("q_group").alias("matter"), F.round("similarity", 5).alias("similarity"))


HITS = "(length(lower(d.text)) - length(replace(lower(d.text), 'que', ''))) / 3"
RRF = f"""
    WITH t AS (SELECT doc_id AS id, ROW_NUMBER() OVER (ORDER BY {HITS} DESC, doc_id) AS r FROM {{documents}} d WHERE contains(lower(text), 'que') AND lang IN ('fr', 'es') ORDER BY {HITS} DESC, doc_id LIMIT 40),
    v AS (SELECT e.vec_id AS id, ROW_NUMBER() OVER (ORDER BY ROUND({SIM}, 9) DESC, e.vec_id) AS r FROM {{embeddings}} e, {Q0} ORDER BY ROUND({SIM}, 9) DESC, e.vec_id LIMIT 40)
    SELECT COALESCE(t.id, v.id) AS id, ROUND(COALESCE(1.0 / (50 + t.r), 0) + COALESCE(1.0 / (50 + v.r), 0), 9) AS score FROM t FULL JOIN v ON t.id = v.id ORDER BY 2 DESC, 1 LIMIT 20"""


def arms(c: Civic) -> tuple[DataFrame, DataFrame]:
    low = F.lower("text")
    hits = (F.length(low) - F.length(F.replace(low, F.lit("que"), F.lit("")))) / 3
    text = c.documents.where(F.col("lang").isin("fr", "es") & low.contains("que")).select(F.col("doc_id").alias("id"), hits.alias("score"))
    q = F.array(*[F.lit(float(x)) for x in vector(c)])
    return text, c.embeddings.withColumn("q", q).select(F.col("vec_id").alias("id"), F.round(joins.cosine("embedding", "q"), 9).alias("score"))


@query("hyb01_reciprocal_rank_fusion", RRF)
def hyb01(c: Civic) -> DataFrame:
    return ops.fused(*arms(c), k=20).withColumn("score", F.round("score", 9))


@query("hyb05_text_arm_alone", RRF.replace("COALESCE(1.0 / (50 + v.r), 0)", "0").replace("FULL JOIN v ON t.id = v.id", "LEFT JOIN (SELECT id AS id, r FROM v WHERE FALSE) v ON t.id = v.id"))
def hyb05(c: Civic) -> DataFrame:
    text, _ = arms(c)
    return ops.fused(text, text.where("false"), k=20, vector_weight=0.0).withColumn("score", F.round("score", 9))


@query("hyb06_matter_keywords", "SELECT id, CAST(ROUND(0.04 + CASE WHEN contains(lower(title), 'ring') AND contains(lower(title), 'small') THEN 0.08 ELSE 0 END + CASE WHEN contains(lower(COALESCE(identifier, '')), 'ring') AND contains(lower(COALESCE(identifier, '')), 'small') THEN 0.08 ELSE 0 END + CASE WHEN contains(lower(address), 'ring') AND contains(lower(address), 'small') THEN 0.03 ELSE 0 END, 6) AS DOUBLE) AS score FROM {matters} WHERE contains(lower(title || ' ' || COALESCE(identifier, '') || ' ' || address), 'ring') AND contains(lower(title || ' ' || COALESCE(identifier, '') || ' ' || address), 'small')")
def hyb06(c: Civic) -> DataFrame:
    score = ops.matter_score(["ring", "small"], F.col("title"), F.col("identifier"), F.col("address"))
    return c.matters.select("id", F.round(score, 6).alias("score")).where("score is not null")


@query("hyb07_relevance", "SELECT id, ROUND(0.02 * (1 + 0.6 * EXP(-((DATE '2001-12-31' - meeting_date) / 365.25) / 2)) * CASE WHEN contains(lower(title), 'urgent') THEN 1.3 ELSE 1.0 END, 9) AS score FROM {meetings}")
def hyb07(c: Civic) -> DataFrame:
    return c.meetings.select("id", F.round(ops.relevance(F.lit(0.02), F.col("meeting_date"), "2001-12-31", F.col("title"), "urgent"), 9).alias("score"))


@query("hyb09_search_all", """
    WITH r AS (SELECT 'motion' AS type, id, meeting_id, text AS title FROM {motions} WHERE contains(lower(text), 'small') UNION ALL SELECT 'item', id, meeting_id, title FROM {agenda_items} WHERE contains(lower(title), 'small'))
    SELECT r.type, r.id, ROUND(0.05 * (1 + 0.6 * EXP(-((DATE '2001-12-31' - g.meeting_date) / 365.25) / 2)) * 1.3, 9) AS score FROM r JOIN {meetings} g ON g.id = r.meeting_id ORDER BY ROUND(0.05 * (1 + 0.6 * EXP(-((DATE '2001-12-31' - g.meeting_date) / 365.25) / 2)) * 1.3, 9) DESC, r.type, r.id LIMIT 30""")
def hyb09(c: Civic) -> DataFrame:
    found = lambda df, kind, text: df.where(F.lower(text).contains("small")).select(F.lit(kind).alias("type"), "id", "meeting_id", F.col(text).alias("title"))
    rows = found(c.motions, "motion", "text").unionByName(found(c.agenda_items, "item", "title")).join(c.meetings.select(F.col("id").alias("g"), "meeting_date"), F.col("meeting_id") == F.col("g"))
    score = F.round(ops.relevance(F.lit(0.05), F.col("meeting_date"), "2001-12-31", F.col("title"), "small"), 9)
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), "type", "id").limit(30).select("type", "id", "score")


CALLED = "CASE speaker_id % 6 WHEN 0 THEN 'Ann O''Lee' WHEN 1 THEN 'A. O''Lee (public)' WHEN 2 THEN 'Ann O''Lees' WHEN 3 THEN 'Ann O''Lee (public)' WHEN 4 THEN 'A. O''Lee' ELSE 'ann o''lee' END"


@query("hyb08_speaker_search", f"SELECT id, CAST(0.05 AS DOUBLE) AS score FROM (SELECT id, start_time, {CALLED} AS speaker_name FROM {{segments}}) WHERE regexp_full_match(speaker_name, '(Ann|A\\.) O''Lee( \\(public\\))?') ORDER BY start_time, id LIMIT 40")
def hyb08(c: Civic) -> DataFrame:
    return ops.speaker_search(c.segments.withColumn("speaker_name", F.expr(CALLED.replace("''", "\\'"))), " Ann  O'Lee", 40)


@query("hyb11_rerank", "SELECT id, place FROM (SELECT id, id % 6 AS score, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY id % 6 DESC, id) AS place FROM {segments}) WHERE score >= 3 OR place <= 3")
def hyb11(c: Civic) -> DataFrame:
    from agora.operators.windows import first_of

    rows = first_of(c.segments.withColumn("score", F.col("id") % 6), ["meeting_id"], [F.col("score").desc(), F.col("id")], 2**31 - 1)
    return rows.where("score >= 3 or place <= 3").select("id", F.col("place").cast("long").alias("place"))


@query("fts01_postings", None)
def fts01(c: Civic) -> DataFrame:
    return ops.postings(c.matters, "id", ["title", "identifier"])


@query("fts02_web_search", """
    WITH w AS (SELECT id, ' ' || array_to_string(regexp_extract_all(lower(concat_ws(' ', title, identifier)), '[a-z0-9]+'), ' ') || ' ' AS x FROM {matters})
    SELECT id FROM w WHERE contains(x, ' small ring ') OR contains(x, ' small rings ') OR (regexp_matches(x, ' widgets? ') AND NOT regexp_matches(x, ' econom(y|ies) '))""")
def fts02(c: Civic) -> DataFrame:
    q = ops.web_query('"small ring" or widgets -economy')
    return ops.matches(ops.postings(c.matters, "id", ["title", "identifier"]), "id", q).select("id")


@query("fts03_text_rank", """
    WITH w AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', title, address)), '[a-z0-9]+') AS ws FROM {matters}), e AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
    h AS (SELECT id, p, word IN ('small', 'smalls') AS first, lag(p) OVER o AS before, lag(word IN ('small', 'smalls')) OVER o AS first_before FROM e WHERE word IN ('small', 'smalls', 'promo', 'promos') WINDOW o AS (PARTITION BY id ORDER BY p))
    SELECT id, SUM(0.1 / (p - before)) AS rank FROM h WHERE first <> first_before GROUP BY id""")
def fts03(c: Civic) -> DataFrame:
    q = ops.web_query("small promo")
    found = ops.matches(ops.postings(c.matters, "id", ["title", "address"]), "id", q)
    return ops.text_rank(found, "id", q.terms)


@query("fts04_all_words", "SELECT id FROM {matters} WHERE list_contains(regexp_extract_all(lower(title), '[a-z0-9]+'), 'small') AND list_contains(regexp_extract_all(lower(title), '[a-z0-9]+'), 'ring')")
def fts04(c: Civic) -> DataFrame:
    words = ops.tokens(F.col("title"))
    return c.matters.where(F.array_contains(words, "small") & F.array_contains(words, "ring")).select("id")


@query("vec04_match_agenda_items", f"SELECT i.id, i.title, ROUND({SIM}, 5) AS similarity FROM {{embeddings}} e JOIN {{agenda_items}} i ON i.id = e.vec_id, {Q0} WHERE {SIM} > 0.1 ORDER BY {SIM} DESC, i.id LIMIT 30")
def vec04(c: Civic) -> DataFrame:
    rows = c.embeddings.join(c.agenda_items.select("id"), F.col("vec_id") == F.col("id"), "left_semi")
    best = ops.vector_match(rows, vector(c), 0.1, 50)
    return best.join(c.agenda_items.select("id", "title"), F.col("vec_id") == F.col("id")).select("id", "title", F.round("similarity", 5).alias("similarity"))


STATEMENT = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'transcript' ELSE 'minutes' END"


@query("vec05_match_key_statements", f"SELECT s.id, ROUND({SIM}, 5) AS similarity FROM {{embeddings}} e JOIN (SELECT id FROM {{segments}} WHERE {STATEMENT} IS NULL OR {STATEMENT} = 'transcript') s ON s.id = e.vec_id, {Q0} WHERE {SIM} > 0.0 ORDER BY {SIM} DESC, s.id LIMIT 12")
def vec05(c: Civic) -> DataFrame:
    spoken = c.segments.where(f"{STATEMENT} is null or {STATEMENT} = 'transcript'").select("id")
    rows = c.embeddings.join(spoken, F.col("vec_id") == F.col("id"), "left_semi")
    return ops.vector_match(rows, vector(c), 0.0, 12).select(F.col("vec_id").alias("id"), F.round("similarity", 5).alias("similarity"))


@query("vec07_match_document_sections", f"SELECT d.doc_id AS id, left(d.text, 500) AS content, ROUND({SIM}, 5) AS similarity FROM {{embeddings}} e JOIN {{documents}} d ON d.doc_id = e.vec_id, {Q0} WHERE {SIM} > 0.05 ORDER BY {SIM} DESC, d.doc_id LIMIT 10")
def vec07(c: Civic) -> DataFrame:
    rows = c.embeddings.join(c.documents.select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi")
    best = ops.vector_match(rows, vector(c), 0.05, 10)
    return best.join(c.documents.select("doc_id", "text"), F.col("vec_id") == F.col("doc_id")).select(F.col("doc_id").alias("id"), F.substring("text", 1, 500).alias("content"), F.round("similarity", 5).alias("similarity"))


def arm_sql(table: str, key: str, limit: int, least: float) -> str:
    return f"(SELECT '{table}' AS type, {key} AS id, {SIM} AS similarity FROM {{embeddings}} e JOIN {{{table}}} t ON t.{key} = e.vec_id, {Q0} WHERE {SIM} > {least} ORDER BY {SIM} DESC, {key} LIMIT {limit})"


@query("vec09_search_all_types", "SELECT type, id, ROUND(similarity, 5) AS similarity FROM (" + " UNION ALL ".join(arm_sql(*x, 0.05) for x in (("motions", "id", 5), ("matters", "id", 5), ("agenda_items", "id", 8))) + ")")
def vec09(c: Civic) -> DataFrame:
    """A limit for each type; segments have no vectors to search."""
    tables = [(name, getattr(c, name).select(F.col("id").alias("vec_id")), limit) for name, limit in (("motions", 5), ("matters", 5), ("agenda_items", 8))]
    found = ops.vector_search_all(c.embeddings, tables, vector(c), 0.05)
    return found.select("type", F.col("vec_id").alias("id"), F.round("similarity", 5).alias("similarity"))


def hybrid_sql(rows: str, word: str, label: str) -> str:
    """Reciprocal ranks of rows (id, content) by how often a word is in them, and of the vectors with a label."""
    hits = f"(length(lower(content)) - length(replace(lower(content), '{word}', ''))) / {len(word)}"
    return f"""
    WITH d AS ({rows}),
    t AS (SELECT id, ROW_NUMBER() OVER (ORDER BY {hits} DESC, id) AS r FROM d WHERE contains(lower(content), '{word}') ORDER BY {hits} DESC, id LIMIT 20),
    v AS (SELECT e.vec_id AS id, ROW_NUMBER() OVER (ORDER BY ROUND({SIM}, 9) DESC, e.vec_id) AS r FROM {{embeddings}} e JOIN d ON d.id = e.vec_id, {Q0} WHERE {label} ORDER BY ROUND({SIM}, 9) DESC, e.vec_id LIMIT 20),
    f AS (SELECT COALESCE(t.id, v.id) AS id, ROUND(COALESCE(1.0 / (50 + t.r), 0) + COALESCE(1.0 / (50 + v.r), 0), 9) AS score FROM t FULL JOIN v ON t.id = v.id ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT f.id, left(d.content, 500) AS content, f.score FROM f JOIN d ON d.id = f.id"""


def hybrid(c: Civic, rows: DataFrame, word: str, kept: DataFrame) -> DataFrame:
    low = F.lower("content")
    hits = (F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)
    text = rows.where(low.contains(word)).select("id", hits.alias("score"))
    q = F.array(*[F.lit(float(x)) for x in vector(c)])
    near = kept.join(rows.select("id"), F.col("vec_id") == F.col("id"), "left_semi").withColumn("q", q).select(F.col("vec_id").alias("id"), F.round(joins.cosine("embedding", "q"), 9).alias("score"))
    best = ops.fused(text, near, k=10).withColumn("score", F.round("score", 9))
    return best.join(rows.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("id", F.substring("content", 1, 500).alias("content"), "score")


@query("hyb02_key_statements", hybrid_sql(f"SELECT id, text AS content FROM {{segments}} WHERE {STATEMENT} IS NULL OR {STATEMENT} = 'transcript'", "view", "TRUE"))
def hyb02(c: Civic) -> DataFrame:
    return hybrid(c, c.segments.where(f"{STATEMENT} is null or {STATEMENT} = 'transcript'").select("id", F.col("text").alias("content")), "view", c.embeddings)


@query("hyb03_document_sections", hybrid_sql("SELECT doc_id AS id, text AS content FROM {documents} WHERE lang IN ('fr', 'es')", "que", "TRUE"))
def hyb03(c: Civic) -> DataFrame:
    return hybrid(c, c.documents.where(F.col("lang").isin("fr", "es")).select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "que", c.embeddings)


@query("hyb04_bylaw_chunks", hybrid_sql("SELECT id, title AS content FROM {matters} WHERE identifier IS NOT NULL", "ring", "e.label <> 3"))
def hyb04(c: Civic) -> DataFrame:
    return hybrid(c, c.matters.where("identifier is not null").select("id", F.col("title").alias("content")), "ring", c.embeddings.where("label <> 3"))


PAGED = {"people": ("name", "supplier#00000000", "balance"), "matters": ("title", "ring", "year"), "agenda_items": ("title", "ring", "place"), "motions": ("text", "ring", "meeting_id"), "segments": ("text", "view", "start_time")}


@query("hyb12_search_page", "WITH a AS (" + " UNION ALL ".join(f"SELECT '{k}' AS type, id, 0.1 - (ROW_NUMBER() OVER (ORDER BY {by} DESC, id) - 1) / COUNT(*) OVER () * 0.09 AS score FROM (SELECT * FROM {{{k}}} WHERE contains(lower({text}), '{word}') ORDER BY {by} DESC, id LIMIT 50)" for k, (text, word, by) in PAGED.items()) + ") SELECT type, id, ROUND(score, 9) AS score FROM a ORDER BY ROUND(score, 9) DESC, type, id LIMIT 20 OFFSET 20")
def hyb12(c: Civic) -> DataFrame:
    arms_ = [(k, getattr(c, k).where(F.lower(text).contains(word)).select("id", F.col(by).alias("by"))) for k, (text, word, by) in PAGED.items()]
    return ops.search_page(arms_, page=2, size=20, most=50)
