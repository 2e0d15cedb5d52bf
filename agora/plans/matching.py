"""What identifies a matter, and the stages that match items to matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import matters as m
from agora.functions import text as t
from agora.operators import matching as ops
from agora.plans.registry import query
from agora.sources.civic import Civic

#: Entities of the town that the matters are about: invented, like the titles below that name them.
ENTITIES: m.Entities = {
    "harbour_pool": (["harbour pool", "seaside baths", "swimmers' society"], ["lease", "operating", "agreement", "rent", "reserve fund"]),
    "north_arena": (["north arena", "old ice hall", "arena field"], ["lease", "naming", "budget", "capital", "event"]),
    "mill_lane": (["mill lane corridor", "mill lane works"], ["award", "sidewalk", "traffic", "frontage"]),
}
#: Spellings of identifiers, titles and addresses that the matters of the tables don't have themselves.
IDENT = """CASE id % 8 WHEN 0 THEN 'Bylaws Nos. ' || CAST(id AS STRING) || ', ' || CAST(id + 1 AS STRING) || ' & ' || CAST(id + 2 AS STRING) WHEN 1 THEN CAST(1000 + id % 2000 AS STRING) || '; 12 ; x'
  WHEN 2 THEN 'TUP16-00' || CAST(10 + id % 90 AS STRING) || ' (Renewal); Rezoning Application No. 2025/0' || CAST(id % 9 AS STRING) WHEN 3 THEN 'Amendment Bylaw No. ' || CAST(id AS STRING) WHEN 4 THEN 'Development  Permit  No. 2024-02;;A  b' ELSE identifier END"""
TITLE = """CASE id % 12 WHEN 0 THEN 'Draft ' || title || ' Strategy 2024 (approx. 20 min)' WHEN 1 THEN 'Adoption of the ' || title || ' Plan' WHEN 2 THEN title || ' Plan - procurement' WHEN 3 THEN '8.1 North Arena lease of ' || title
  WHEN 4 THEN 'Rezoning for ' || CAST(id AS STRING) || ' Oak Ave and 12 Low Hill Rd' WHEN 5 THEN 'Presentations:' WHEN 6 THEN 'Bylaw No. ' || CAST(id AS STRING) || ' and Bylaws Nos. 7, 8' WHEN 7 THEN 'Permit to vary Bylaw No. ' || CAST(id AS STRING) WHEN 8 THEN 'Update' ELSE title END"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def short_sql(x: str) -> str:
    found = f"WHEN regexp_matches({x}, {lit(m.BYLAW)}) THEN 'Bylaw ' || regexp_extract({x}, {lit(m.BYLAW)}, 1) WHEN regexp_matches({x}, {lit(m.FILE)}) THEN upper(regexp_extract({x}, {lit(m.FILE)}, 1)) || ' ' || regexp_extract({x}, {lit(m.FILE)}, 2)"
    for label, p in m.NUMBERED.items():
        found += f" WHEN regexp_matches({x}, {lit(p)}) THEN '{label} ' || replace(regexp_extract({x}, {lit(p)}, 1), '/', '-')"
    return f"CASE {found} ELSE trim(regexp_replace({x}, '\\s+', ' ', 'g')) END"


def identifiers_sql(x: str) -> str:
    one = f"CASE WHEN regexp_matches(p, '^\\d{{{{3,4}}}}$') AND NOT TRY_CAST(p AS INT) BETWEEN 2000 AND 2035 THEN ['Bylaw ' || p] WHEN regexp_matches(p, {lit(m.PLURAL)}) THEN list_transform(regexp_extract_all(regexp_extract(p, {lit(m.PLURAL)}, 1), '\\d+(?:-\\d+)?'), lambda n: 'Bylaw ' || n) WHEN length({short_sql('p')}) > 2 THEN [{short_sql('p')}] ELSE [] END"
    return f"flatten(list_transform(list_transform(string_split(COALESCE({x}, ''), ';'), lambda y: trim(y)), lambda p: {one}))"


def bylaws_sql(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(COALESCE({x}, ''), {lit(m.NAMED_BYLAW)}, 1), flatten(list_transform(regexp_extract_all(COALESCE({x}, ''), {lit(m.NAMED_BYLAWS)}, 1), lambda y: regexp_extract_all(y, '\\d+')))), lambda n: 'Bylaw ' || n)))"


def address_sql(x: str) -> str:
    out = f"lower(trim({x}))"
    for short, long in m.KINDS.items():
        out = f"regexp_replace({out}, '\\b{short}\\b', '{long}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def any_sql(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def entity_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(f'lower({x})', a)} AND {any_sql(f'lower({x})', b)} THEN '{k}'" for k, (a, b) in ENTITIES.items()) + " END"


def stage_sql(x: str) -> str:
    for _ in range(3):
        less = f"trim(regexp_replace({x}, {lit(t.STAGE)}, ''), '{t.STAGE_ENDS}')"
        x = f"(SELECT CASE WHEN length(l) < 6 THEN y ELSE l END FROM (SELECT y, trim(regexp_replace(y, {lit(t.STAGE)}, ''), '{t.STAGE_ENDS}') AS l FROM (SELECT {x} AS y)))" if x else less
    return x


def bare_sql(x: str) -> str:
    inner = f"regexp_replace(regexp_replace(trim({x}), '^\\s*\\d+(?:\\.\\d+)?[.)]?\\s+', ''), '(?i)\\s*\\(approx\\.[^)]+\\)\\s*$', '')"
    return f"trim(regexp_replace({stage_sql(f'trim({inner})')}, '\\s+', ' ', 'g'))"


@query("str10_compound_identifiers", f"SELECT id, array_to_string({identifiers_sql('x')}, '|') AS identifiers FROM (SELECT id, {IDENT} AS x FROM {{matters}})")
def str10(c: Civic) -> DataFrame:
    return c.matters.withColumn("x", F.expr(IDENT)).select("id", F.array_join(m.identifiers("x"), "|").alias("identifiers"))


@query("str11_identifier", f"SELECT id, {short_sql('x')} AS ident FROM (SELECT id, trim({IDENT}) AS x FROM {{matters}})")
def str11(c: Civic) -> DataFrame:
    return c.matters.withColumn("x", F.expr(IDENT)).select("id", m.short_identifier("x").alias("ident"))


@query("str12_bylaw_numbers", f"""
    WITH i AS (SELECT id, title, {identifiers_sql('x')} AS own FROM (SELECT id, {TITLE} AS title, {IDENT} AS x FROM {{matters}}))
    SELECT id, array_to_string({bylaws_sql('title')}, '|') AS named, array_to_string(list_sort(list_distinct(CASE WHEN len(list_filter(own, lambda y: starts_with(y, 'Bylaw '))) = 0 AND NOT regexp_matches(title, {lit(m.PARENT)}) THEN list_concat(own, {bylaws_sql('title')}) ELSE own END)), '|') AS idents FROM i""")
def str12(c: Civic) -> DataFrame:
    rows = c.matters.select("id", F.expr(TITLE).alias("title"), F.expr(IDENT).alias("x"))
    return rows.select("id", F.array_join(m.named_bylaws("title"), "|").alias("named"), F.array_join(m.matter_identifiers("x", "title"), "|").alias("idents"))


@query("str13_address", f"SELECT id, {address_sql('a')} AS address, array_to_string(list_transform(regexp_extract_all(title, {lit(m.ADDRESS)}, 1), lambda x: {address_sql('x')}), '|') AS named FROM (SELECT id, {TITLE} AS title, replace(address, 'Street', CASE WHEN id % 2 = 0 THEN 'St' ELSE ' Cres ' END) AS a FROM {{matters}})")
def str13(c: Civic) -> DataFrame:
    a = F.replace("address", F.lit("Street"), F.when(F.col("id") % 2 == 0, "St").otherwise(" Cres "))
    return c.matters.select("id", m.plain_address(a).alias("address"), F.array_join(m.addresses_in(F.expr(TITLE)), "|").alias("named"))


@query("str15_generic_matters", f"""
    WITH b AS (SELECT id, title, category, rtrim(lower({bare_sql('title')}), ':') AS low FROM (SELECT id, {TITLE} AS title, CASE WHEN id % 50 = 0 THEN ' Consent Agenda' ELSE category END AS category FROM {{matters}}))
    SELECT id, list_contains({listed(m.GENERIC)}, low) OR starts_with(low, 'reports - ') OR regexp_matches(low, {lit(m.CONTAINER)}) OR list_contains({listed(m.GENERIC_CATEGORIES)}, lower(trim(category))) AS generic, {entity_sql('title')} AS entity,
      array_to_string(list_filter([{", ".join(f"CASE WHEN {any_sql('lower(title)', words)} THEN '{k}' END" for k, words in m.CATEGORIES.items())}], lambda x: x IS NOT NULL), '|') AS categories FROM b""")
def str15(c: Civic) -> DataFrame:
    rows = c.matters.select("id", F.expr(TITLE).alias("title"), F.when(F.col("id") % 50 == 0, " Consent Agenda").otherwise(F.col("category")).alias("category"))
    return rows.select("id", m.is_generic("title", "category").alias("generic"), m.entity_in("title", ENTITIES).alias("entity"), F.array_join(m.categories_in("title"), "|").alias("categories"))


def dressed_sql(x: str) -> str:
    for k, p in enumerate(m.POLICY_DRESS):
        x = f"regexp_replace({x}, {lit(p)}, '')"
        x = f"trim({x})" if k in (0, 3) else x
    return x


@query("str16_policy_identity", f"""
    WITH d AS (SELECT id, {dressed_sql('title')} AS x FROM (SELECT id, {TITLE} AS title FROM {{matters}})),
    b AS (SELECT id, x, {bare_sql('x')} AS bare FROM d)
    SELECT id, CASE WHEN regexp_matches(x, {lit(m.POLICY)}) AND NOT regexp_matches(x, {lit(m.ABOUT_POLICY)}) AND NOT regexp_matches(lower(bare), {lit(m.CONTAINER)}) AND NOT list_contains({listed(m.GENERIC)}, lower(bare))
      AND (regexp_matches(lower(regexp_replace(regexp_replace(bare, {lit(m.INSTRUMENT)}, ' ', 'g'), {lit(m.NO_SUBJECT)}, ' ', 'g')), '[a-z]{{{{3,}}}}') OR {entity_sql('x')} IS NOT NULL OR ({any_sql('lower(bare)', m.SUBSTANTIVE)} AND len(string_split(bare, ' ')) >= 3))
      THEN array_to_string(regexp_extract_all(replace(lower(x), '&', ' and '), '\\w+'), ' ') END AS policy FROM b""")
def str16(c: Civic) -> DataFrame:
    return c.matters.select("id", m.policy_identity(F.expr(TITLE), ENTITIES).alias("policy"))


#: Numbered references among addresses, years, fractions and other numbers, around the matter's own title.
REFERENCE = """title || CASE id % 13 WHEN 0 THEN ' Zoning Bylaw ' || CAST(id % 3000 AS STRING) || ' Oak Hill Avenue' WHEN 1 THEN ' Tax Rate Bylaw ' || CAST(1980 + id % 70 AS STRING) WHEN 2 THEN ' Bylaw No. ' || CAST(id % 2500 AS STRING) || ', ' || CAST(1890 + id % 140 AS STRING) || ' and Bylaw No. 0' || CAST(id % 900 AS STRING)
  WHEN 3 THEN ' Bylaw Nos. ' || CAST(id % 900 + 1 AS STRING) || ', 12 & 12 and ' || CAST(id % 77 AS STRING) || ' of No. 4' WHEN 4 THEN ' Omnibus No. 68 of Standards Bylaw (No. ' || CAST(id % 3000 AS STRING) || ')' WHEN 5 THEN ' Amendment No. ' || CAST(id AS STRING)
  WHEN 6 THEN ' by-law #' || CAST(id % 900 + 1 AS STRING) || '.5 or by-law ' || CAST(id % 900 + 1 AS STRING) WHEN 7 THEN ' BYLAW NOS ' || CAST(id % 90 AS STRING) || ' and no. ' || CAST(id % 91 AS STRING) || ', 14 Low Mill Rd' WHEN 8 THEN ' Bylaw' || CAST(id AS STRING) || ' & bylaw numbers ' || CAST(id % 1000 AS STRING) || ', 7'
  WHEN 9 THEN ' (Nos. ' || CAST(id % 400 AS STRING) || ', 8) bylaw no' || CAST(id % 40 AS STRING) WHEN 10 THEN ' bylaws ' || CAST(id % 50 AS STRING) || ', bylaw ' || CAST(id % 60 AS STRING) || ' - ' || CAST(id % 9 AS STRING) || 'b  St. Elm High Street' WHEN 11 THEN ' By-law 000 by-law No. ' || CAST(10000 + id AS STRING) ELSE ' and no bylaw' END"""
#: The same marks in SQL without looking around: fractions get a tilde, other numbers of four digits at most brackets.
MARK = r"<\d+>"
LISTED = rf"(?i)\bby-?law\s*nos\.?\s*{MARK}(?:\s*(?:,|&|and)\s*(?:no\.?\s*)?{MARK})*"
MENTIONED = rf"{LISTED}|\bby-?law\s*(?:nos?\.?|numbers?|#)?\s*{MARK}|(?:by-?law\s*\(?|\()\s*nos?\.\s*{MARK}"
DATED = rf"(?i)(?:\bby-?law\s*(?:nos?\.?|numbers?|#)?|\bnos?\.)\s*{MARK}\s*,\s*<((?:19|20)\d{{2}})>"


def marked_sql(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '(\\d)[.,](\\d)', '\\1~\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '(^|[^\\d~<])(\\d{{{{1,4}}}})([^\\d~>]|$)', '\\1<\\2>\\3', 'g')"
    return x


@query("str17_referenced_bylaws", f"""
    WITH raw AS (SELECT id, {REFERENCE} AS x FROM {{matters}}), marked AS (SELECT id, {marked_sql("x")} AS whole, {marked_sql(f"regexp_replace(x, {lit(m.HOUSES.replace('(?<!' + chr(92) + 'd)', '(^|' + chr(92) + 'D)'))}, '{chr(92)}1 ', 'g')")} AS t FROM raw),
    mention AS (SELECT id, whole, unnest(regexp_extract_all(t, {lit(MENTIONED)})) AS y FROM marked),
    found AS (SELECT id, regexp_extract_all(y, '<([0-9]+)>', 1) AS ns, regexp_matches(y, '(?i)^by-?law *nos') AS many, NOT regexp_matches(y, '(?i)no|#|number') AS bare FROM mention),
    each AS (SELECT id, row_number() OVER () AS k, CASE WHEN many THEN ns WHEN bare AND length(ns[1]) = 4 AND CAST(ns[1] AS INT) BETWEEN 1990 AND 2027 THEN [] ELSE ns[1:1] END AS ns FROM found),
    flat AS (SELECT id, k, unnest(ns) AS n, unnest(range(len(ns))) AS j FROM each), firsts AS (SELECT id, CAST(n AS INT) AS n, MIN((k, j)) AS first FROM flat WHERE CAST(n AS INT) <> 0 GROUP BY id, CAST(n AS INT)),
    lists AS (SELECT id, string_agg(CAST(n AS VARCHAR), '|' ORDER BY first) AS numbers FROM firsts GROUP BY id)
    SELECT w.id, COALESCE(l.numbers, '') AS numbers, TRY_CAST(regexp_extract(w.whole, {lit(DATED)}, 1) AS INT) AS enacted FROM marked w LEFT JOIN lists l ON l.id = w.id""")
def str17(c: Civic) -> DataFrame:
    found = c.matters.withColumn("x", F.expr(REFERENCE)).select("id", m.referenced_bylaws("x", 2027).alias("f"))
    return found.select("id", F.array_join("f.numbers", "|").alias("numbers"), F.col("f.enacted").alias("enacted"))


def matter_table(c: Civic) -> DataFrame:
    """The matters of the tables with what matching asks for."""
    return c.matters.select(
        "id",
        F.when(F.col("id") % 40 == 1, F.concat("identifier", F.lit("; Bylaw 77"))).otherwise(F.col("identifier")).alias("identifier"),
        F.when(F.col("id") % 12 == 1, F.concat(F.lit("Final "), "title", F.lit(" Plan"))).when(F.col("id") % 12 == 3, F.concat(F.lit("North Arena lease of "), "title")).otherwise(F.concat("title", F.lit(" rezoning"))).alias("title"),
        F.array("address").alias("addresses"),
        F.make_date("year", F.lit(1), F.lit(1)).alias("first_seen"),
        F.when(F.col("id") % 5 != 0, F.make_date(F.col("year") + 2, F.lit(1), F.lit(1))).alias("last_seen"),
        "canonical_id",
        F.coalesce("hidden", F.lit(False)).alias("hidden"),
        F.array().cast("array<string>").alias("clusters"),
        (F.col("id") % 99 == 3).alias("canonical"),
    )


def item_table(c: Civic) -> DataFrame:
    """Every matter once more as an agenda item, spelt otherwise."""
    return c.matters.select(
        "id",
        F.when(F.col("id") % 4 == 0, F.col("identifier")).when(F.col("id") % 40 == 1, F.concat(F.lit("Bylaws Nos. 77 & "), (F.col("id") % 300).cast("string"))).alias("identifier"),
        F.when(F.col("id") % 12 == 1, F.concat(F.lit("Adoption of the "), "title", F.lit(" Plan"))).when(F.col("id") % 12 == 3, F.concat(F.lit("North Arena lease, "), "title")).otherwise(F.concat("title", F.lit(" rezoning - second reading"))).alias("title"),
        F.when(F.col("id") % 3 == 0, F.array("address")).alias("addresses"),
        F.make_date(F.col("year") + (F.col("id") % 4).cast("int"), F.lit(6), F.lit(1)).alias("day"),
    )


#: Items and matters with one to three bylaws, some at one address, in one street, or under one title; other titles are far apart.
TITLED = "concat(md5(CAST({k} AS STRING)), md5(CAST({k} + 1 AS STRING)), CASE WHEN id % 9 = 0 THEN ' Oak Road' ELSE '' END)"
CORROBORATED = (
    "SELECT id, 'Bylaw ' || CAST(id % 300 AS STRING) || CASE id % 4 WHEN 0 THEN '; Bylaw 777' WHEN 1 THEN '; Bylaw 777; Bylaw 778' ELSE '' END AS identifier, " + TITLED.format(k="id % 600") + " AS title, address FROM {matters}",
    "SELECT id, 'Bylaw ' || CAST(id % 300 AS STRING) || CASE id % 3 WHEN 0 THEN '; Bylaw 777' ELSE '' END AS identifier, " + TITLED.format(k="CASE WHEN id % 5 < 2 THEN id % 600 ELSE id + 10000 END") + " AS title, CASE WHEN id % 2 = 0 THEN address ELSE 'x' END AS address FROM {matters}",
)


@query("joi23_corroborated_sets", f"""
    WITH k AS (SELECT id, title, address AS addr, list_sort(list_distinct({identifiers_sql('identifier')})) AS laws FROM ({CORROBORATED[0]})), i AS (SELECT id, title, address AS addr, list_sort(list_distinct({identifiers_sql('identifier')})) AS laws FROM ({CORROBORATED[1]})),
    e AS (SELECT id, unnest(laws) AS law FROM i), f AS (SELECT id, unnest(laws) AS law FROM k), met AS (SELECT DISTINCT e.id AS item_id, f.id AS matter_id FROM e JOIN f ON e.law = f.law)
    SELECT item_id, matter_id, i.laws = k.laws AS same FROM met JOIN i ON i.id = item_id JOIN k ON k.id = matter_id
    WHERE i.laws = k.laws OR (GREATEST(len(i.laws), len(k.laws)) <= 2 AND (list_has_all(i.laws, k.laws) OR list_has_all(k.laws, i.laws)) AND ({address_sql('i.addr')} = {address_sql('k.addr')} OR (ends_with(i.title, ' Oak Road') AND ends_with(k.title, ' Oak Road')) OR left(i.title, 64) = left(k.title, 64)))""")
def joi23(c: Civic) -> DataFrame:
    matters, items = (c.spark.sql(x, matters=c.matters).withColumn("addresses", F.array("address")) for x in CORROBORATED)
    return ops.corroborated(items, matters)


@query("ent01_match_cascade", None)
def ent01(c: Civic) -> DataFrame:
    return ops.match_cascade(item_table(c), matter_table(c), ENTITIES).withColumn("confidence", F.round("confidence", 6))


def staged(c: Civic) -> tuple[DataFrame, DataFrame]:
    items = ops.prepared(item_table(c), ENTITIES).withColumn("parts_raw", m.identifiers("identifier"))
    return items, ops.prepared(matter_table(c).where("canonical_id is null"), ENTITIES)


@query("ent02_identifier_stage", None)
def ent02(c: Civic) -> DataFrame:
    return ops.by_identifier(*staged(c))


@query("ent03_entity_stage", None)
def ent03(c: Civic) -> DataFrame:
    return ops.by_entity(*staged(c))


@query("ent04_place_stage", None)
def ent04(c: Civic) -> DataFrame:
    return ops.by_place(*staged(c))


@query("ent05_title_similarity", None)
def ent05(c: Civic) -> DataFrame:
    return ops.best_titles(item_table(c), matter_table(c), ENTITIES).withColumn("similarity", F.round("similarity", 6))


@query("ent16_policy_stage", f"""
    WITH raw AS (SELECT id, CASE WHEN id % 12 = 1 THEN 'Final ' || title || ' Plan' ELSE title || ' rezoning' END AS title, identifier, year, canonical_id, COALESCE(hidden, FALSE) AS hidden FROM {{matters}}),
    k AS (SELECT id, lower(title) AS p, year AS low, CASE WHEN id % 5 <> 0 THEN year + 2 END AS high, identifier IS NOT NULL AS numbered FROM (SELECT id, year, identifier, canonical_id, hidden, regexp_replace(title, '^Final ', '') AS title FROM raw WHERE id % 12 = 1) WHERE canonical_id IS NULL AND NOT hidden),
    i AS (SELECT m.id, lower(m.title || ' Plan') AS p, m.year + m.id % 4 AS y FROM {{matters}} m WHERE m.id % 12 = 1 AND NOT (m.id % 40 = 1)),
    j AS (SELECT i.id, i.y, k.id AS kid, k.low, k.high, k.numbered, k.id IS NOT NULL AND (k.low IS NULL OR k.high IS NULL OR i.y BETWEEN k.low AND k.high) AS fits FROM i LEFT JOIN k ON k.p = i.p),
    g AS (SELECT id, COUNT(kid) AS n, COUNT(*) FILTER (fits) AS fit, MIN(kid) FILTER (fits) AS kid, bool_or(fits AND (low IS NULL OR high IS NULL OR numbered)) AS open FROM j GROUP BY id)
    SELECT id AS item_id, CASE WHEN fit = 1 AND NOT open THEN kid END AS matter_id, CASE WHEN fit = 1 AND NOT open THEN 'policy_exact_subject_and_year' WHEN n = 0 THEN 'policy_new' ELSE 'policy_review' END AS reason, CASE WHEN fit = 1 AND NOT open THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence FROM g""")
def ent16(c: Civic) -> DataFrame:
    items, matters = staged(c)
    return ops.by_policy(items, matters)
