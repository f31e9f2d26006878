"""Queries of entity resolution and promotion: authors as typed are the mentions, their stored normal forms the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import names as N
from quillmesh.operators import entities as E
from quillmesh.plans.knowledge import _FOLD
from quillmesh.plans.registry import Registry
from quillmesh.session import table

R = Registry()

_ORG = r"(?:^| )(?:institute|centre|center|foundation|association|university|council|ministry|agency|desk|management|research)(?: |$)"


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """mentions, entities, aliases, asserted names, names together."""
    a = table(spark, sf, "documents_author").where("author is not null").select("document_id", "author", N.fold(F.col("author")).alias("name"), N.fold(F.col("author_norm")).alias("norm"))
    kind = lambda c: F.when(F.col(c).rlike(_ORG), "ORGANIZATION").otherwise("PERSON")
    m = a.select(F.concat_ws("|", "document_id", "author").alias("mention_id"), "document_id", kind("name").alias("type"), "name").distinct()
    known = a.where("norm <> ''")
    e = known.groupBy("norm").agg(F.count("*").alias("k")).select(F.md5("norm").alias("entity_id"), kind("norm").alias("type"), F.col("norm").alias("name"), F.when(F.col("k") >= 3, "authoritative").otherwise("derived").alias("trust"))
    al = known.where("name <> norm and name <> ''").groupBy(F.md5("norm").alias("entity_id"), F.col("name").alias("alias")).agg((F.count("*") >= 2).alias("autolink"))
    said = known.select("document_id", kind("norm").alias("type"), F.col("norm").alias("name")).distinct()
    asserted = m.select("mention_id", "document_id").join(said, "document_id").select("mention_id", "type", "name")
    other = m.select("document_id", F.col("mention_id").alias("other"), "type", "name")
    together = m.select("mention_id", "document_id").join(other, "document_id").where("mention_id <> other").select("mention_id", "type", "name")
    return m, e, al, asserted, together


_TYPE = lambda c: f"CASE WHEN regexp_matches({c}, '{_ORG}') THEN 'ORGANIZATION' ELSE 'PERSON' END"
_SCORED = f"""a AS (SELECT document_id, author, {_FOLD.format('author')} AS name, {_FOLD.format('author_norm')} AS norm FROM documents_author WHERE author IS NOT NULL),
m AS (SELECT DISTINCT document_id || '|' || author AS mention_id, document_id, {_TYPE('name')} AS type, name FROM a), e AS (SELECT md5(norm) AS entity_id, {_TYPE('norm')} AS type, norm AS name, CASE WHEN count(*) >= 3 THEN 'authoritative' ELSE 'derived' END AS trust FROM a WHERE norm <> '' GROUP BY norm),
al AS (SELECT md5(norm) AS entity_id, name AS alias, count(*) >= 2 AS autolink FROM a WHERE norm <> '' AND name <> norm AND name <> '' GROUP BY norm, name), ow AS (SELECT alias, count(DISTINCT entity_id) > 1 AS ambiguous FROM al GROUP BY 1),
c0 AS (SELECT mention_id, document_id, m.type, m.name AS mention, entity_id, e.name, trust, 0 AS way, false AS ambiguous, true AS autolink FROM m JOIN e ON m.name = e.name AND m.type = e.type WHERE m.name <> ''
 UNION ALL SELECT mention_id, document_id, m.type, m.name, e.entity_id, e.name, trust, 1, ow.ambiguous, al.autolink FROM m JOIN al ON al.alias = m.name JOIN ow USING (alias) JOIN e ON e.entity_id = al.entity_id AND e.type = m.type
 UNION ALL SELECT mention_id, document_id, m.type, m.name, entity_id, e.name, trust, 2, false, false FROM m JOIN e ON m.type = 'PERSON' AND e.type = 'PERSON' AND m.name <> '' AND string_split(m.name, ' ')[-1] = string_split(e.name, ' ')[-1] AND m.name[1:1] = e.name[1:1]),
c AS (SELECT mention_id, document_id, type, mention, entity_id, name, trust, unnest(min({{'way': way, 'ambiguous': ambiguous, 'autolink': autolink}}), recursive := true) FROM c0 GROUP BY 1, 2, 3, 4, 5, 6, 7),
one AS (SELECT mention_id, count(*) FILTER (way = 1) = 1 AS one_alias FROM c GROUP BY 1), sd AS (SELECT DISTINCT document_id, {_TYPE('norm')} AS type, norm AS name FROM a WHERE norm <> ''),
ev AS (SELECT c.*, one_alias, EXISTS (SELECT 1 FROM sd WHERE sd.document_id = c.document_id AND sd.type = c.type AND sd.name = c.name) AS asserted, EXISTS (SELECT 1 FROM sd WHERE sd.document_id = c.document_id AND sd.type = 'PERSON') AS persons,
 EXISTS (SELECT 1 FROM m o WHERE o.document_id = c.document_id AND o.mention_id <> c.mention_id AND o.type = c.type AND o.name = c.name) AS near FROM c JOIN one USING (mention_id)),
v AS (SELECT *, list_filter([CASE WHEN ambiguous THEN 'ambiguous_alias' WHEN way = 1 AND NOT autolink THEN 'alias_not_autolinkable' END, CASE WHEN type = 'PERSON' AND NOT regexp_matches(mention, '[a-z0-9]{{2,}}') THEN 'initials_only' END,
 CASE WHEN type = 'PERSON' AND persons AND NOT asserted THEN 'metadata_names_someone_else' END], lambda x: x IS NOT NULL) AS vetoes FROM ev),
s AS (SELECT *, CASE WHEN len(vetoes) > 0 THEN 0.0 ELSE least(1.0, CASE WHEN mention = name THEN 0.6 WHEN way = 1 THEN 0.5 WHEN way = 2 THEN 0.15 ELSE 0 END + CASE WHEN asserted THEN 0.35 ELSE 0 END + CASE WHEN near THEN 0.15 ELSE 0 END
 + CASE WHEN trust = 'authoritative' THEN 0.1 ELSE 0 END + CASE WHEN one_alias AND way = 1 AND autolink THEN 0.1 ELSE 0 END)::DOUBLE END AS score FROM v)"""


@R.query("entity_scores", f"WITH {_SCORED} SELECT mention_id, entity_id, CASE way WHEN 0 THEN 'exact_name' WHEN 1 THEN 'alias' ELSE 'blocked' END AS source, array_to_string(vetoes, ',') AS vetoes, round(score, 6)::DOUBLE AS score FROM s")
def entity_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate of every mention with what speaks against it and its score."""
    m, e, al, asserted, together = _tables(spark, sf)
    s = E.score(E.candidates(m, e, al), asserted, together)
    return s.select("mention_id", "entity_id", "source", F.array_join("vetoes", ",").alias("vetoes"), "score")


@R.query("entity_decisions", f"""WITH {_SCORED}, r AS (SELECT mention_id, type, entity_id, score, asserted, row_number() OVER w AS rn, count(*) OVER (PARTITION BY mention_id) AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY mention_id ORDER BY round(score, 6) DESC, entity_id)),
d AS (SELECT m.mention_id, m.type, entity_id, coalesce(score, 0.0) AS score, coalesce(CASE WHEN n = 1 THEN score ELSE score - second END, 0.0) AS margin, coalesce(n, 0) AS n, coalesce(asserted, false) AS asserted FROM m LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (mention_id)),
k AS (SELECT *, CASE WHEN round(score, 6) >= CASE type WHEN 'PERSON' THEN 0.92 ELSE 0.85 END AND round(margin, 6) >= CASE type WHEN 'PERSON' THEN 0.2 ELSE 0.12 END AND (type <> 'PERSON' OR asserted) THEN 'auto' WHEN round(score, 6) >= CASE type WHEN 'PERSON' THEN 0.55 ELSE 0.5 END THEN 'ambiguous' ELSE 'unresolved' END AS decision FROM d)
SELECT mention_id, decision, CASE WHEN decision = 'auto' THEN entity_id END AS entity_id, round(score, 6)::DOUBLE AS score, round(margin, 6)::DOUBLE AS margin, CAST(n AS BIGINT) AS candidates FROM k""")
def entity_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """What each mention is linked to, if anything."""
    m, e, al, asserted, together = _tables(spark, sf)
    return E.decide(E.score(E.candidates(m, e, al), asserted, together), m)


_NAMES = f"""n AS (SELECT {_FOLD.format('a.author')} AS name, a.document_id, year(d.effective_start_date) AS year, d.source AS division FROM documents_author a LEFT JOIN documents d USING (document_id) WHERE a.author IS NOT NULL),
ev AS (SELECT name, count(DISTINCT document_id) AS documents, min(year) AS first_year, max(year) AS last_year, count(DISTINCT division) AS divisions FROM n WHERE name <> '' GROUP BY 1), su AS (SELECT string_split(name, ' ')[-1] AS surname, count(*) AS k FROM ev GROUP BY 1)"""


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("document_id", F.year("effective_start_date").alias("year"), F.col("source").alias("division"))
    a = table(spark, sf, "documents_author").where("author is not null").select("document_id", N.fold(F.col("author")).alias("name"))
    return E.evidence(a.join(d, "document_id", "left"))


@R.query("author_evidence", f"WITH {_NAMES} SELECT name, documents, CAST(first_year AS INTEGER) AS first_year, CAST(last_year AS INTEGER) AS last_year, divisions FROM ev")
def author_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, years and divisions of every author name."""
    return _evidence(spark, sf)


@R.query("author_promotions", f"""WITH {_NAMES} SELECT name, CASE WHEN NOT regexp_matches(name, '[a-z0-9]{{2,}}') THEN 'initials_only' WHEN len(string_split(name, ' ')) < 2 THEN 'single_word' WHEN len(string_split(name, ' ')) = 2 AND k >= 5 THEN 'shared_surname'
 WHEN last_year - first_year > 20 THEN 'career_span' WHEN divisions > 1 THEN 'several_divisions' END AS refusal FROM ev JOIN su ON su.surname = string_split(name, ' ')[-1]""")
def author_promotions(spark: SparkSession, sf: str) -> DataFrame:
    """Why each author name is not promoted to an entity; null for those that are."""
    e = _evidence(spark, sf)
    surnames = e.groupBy(F.element_at(F.split("name", " "), -1).alias("surname")).agg(F.count("*").alias("n"))
    return E.promotion(e, surnames, 5, 20).select("name", "refusal")


@R.query("organisation_names", r"""WITH a AS (SELECT DISTINCT author FROM documents_author WHERE author IS NOT NULL), w AS (SELECT author, list_filter(string_split(trim(regexp_replace(replace(lower(author), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM a)
SELECT author, array_to_string(list_transform(w, lambda x: CASE x WHEN 'ltd' THEN 'limited' WHEN 'pvt' THEN 'private' WHEN 'inc' THEN 'incorporated' WHEN 'corp' THEN 'corporation' WHEN 'co' THEN 'company' WHEN 'govt' THEN 'government' WHEN 'univ' THEN 'university' WHEN 'inst' THEN 'institute' WHEN 'dept' THEN 'department' WHEN 'assn' THEN 'association' WHEN 'ctr' THEN 'centre' WHEN 'center' THEN 'centre' ELSE x END), ' ') AS organisation FROM w""")
def organisation_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names as those of organisations: & as and, short legal forms written out."""
    return table(spark, sf, "documents_author").where("author is not null").select("author").distinct().select("author", N.organisation(F.col("author")).alias("organisation"))


@R.query("joined_names", r"""SELECT DISTINCT author, CAST(unnest(generate_series(0, len(p) - 1)) AS INTEGER) AS part_index, unnest(p) AS part FROM (SELECT author, list_filter(list_transform(string_split(regexp_replace(author, ',(\S)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents_author WHERE author IS NOT NULL)""")
def joined_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that were joined by commas without a blank, taken apart."""
    d = table(spark, sf, "documents_author").where("author is not null").select("author").distinct()
    return d.select("author", F.posexplode(N.unjoined(F.col("author"))).alias("part_index", "part"))


_SIGNIFICANT = "list_filter(string_split({}, ' '), lambda w: w <> '' AND w NOT IN ('of', 'for', 'and', 'the', 'in', 'on', 'de', 'la'))"


@R.query("acronym_matches", rf"""WITH a AS (SELECT DISTINCT author, lower(regexp_extract(author, '\(([A-Z]{{2,6}})\)', 1)) AS acronym, {_FOLD.format("regexp_replace(author, '\\([A-Z]{2,6}\\)', ' ')")} AS f FROM documents_author WHERE regexp_matches(author, '\([A-Z]{{2,6}}\)')),
i AS (SELECT *, array_to_string(list_transform({_SIGNIFICANT.format('f')}, lambda w: w[1:1]), '') AS initials FROM a)
SELECT author, acronym, initials, starts_with(initials, acronym) OR starts_with(acronym, initials) OR regexp_matches(initials, array_to_string(string_split(acronym, ''), '.*')) AS matches FROM i WHERE initials <> ''""")
def acronym_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an acronym in brackets fits the initials of the name before it."""
    gloss = r"\(([A-Z]{2,6})\)"
    d = table(spark, sf, "documents_author").where(F.col("author").rlike(gloss)).select("author").distinct()
    d = d.select("author", F.lower(F.regexp_extract("author", gloss, 1)).alias("acronym"), N.significant_initials(N.fold(F.regexp_replace("author", r"\([A-Z]{2,6}\)", " "))).alias("initials")).where("initials <> ''")
    return d.select("author", "acronym", "initials", N.acronym_fits(F.col("acronym"), F.col("initials")).alias("matches"))


_PAIR_SQL = r"""w AS (SELECT DISTINCT chunk_id, text FROM chunk WHERE text IS NOT NULL UNION SELECT document_id, author FROM documents_author WHERE author IS NOT NULL),
g AS (SELECT unnest(regexp_extract_all(text, '((?:[A-Z][A-Za-z]+ (?:(?:of|for|and|the|in) )*){1,7}[A-Z][A-Za-z]+) \([A-Z]{2,6}\)')) AS x FROM w)"""


@R.query("expansion_pairs", rf"""WITH {_PAIR_SQL}, p AS (SELECT regexp_extract(x, '\(([A-Z]{{2,6}})\)', 1) AS acronym, trim(regexp_replace(x, '\([A-Z]{{2,6}}\)', '')) AS expansion FROM g), i AS (SELECT acronym, expansion, array_to_string(list_transform({_SIGNIFICANT.format(_FOLD.format('expansion'))}, lambda w: w[1:1]), '') AS initials FROM p)
SELECT acronym, expansion, count(*) AS n FROM i WHERE starts_with(initials, lower(acronym)) OR starts_with(lower(acronym), initials) OR regexp_matches(initials, array_to_string(string_split(lower(acronym), ''), '.*')) GROUP BY 1, 2 HAVING count(*) >= 2""")
def expansion_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a capitalised name and its acronym in brackets from all chunk texts and authors, that fit and come twice or more."""
    texts = table(spark, sf, "chunk").where("text is not null").select("chunk_id", "text").unionByName(table(spark, sf, "documents_author").where("author is not null").select(F.col("document_id").alias("chunk_id"), F.col("author").alias("text"))).distinct()
    x = texts.where(F.col("text").rlike(r"\([A-Z]{2,6}\)")).select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:(?:[A-Z][A-Za-z]+ (?:(?:of|for|and|the|in) )*){1,7}[A-Z][A-Za-z]+) \([A-Z]{2,6}\)"), F.lit(0))).alias("x"))
    p = x.select(F.regexp_extract("x", r"\(([A-Z]{2,6})\)", 1).alias("acronym"), F.trim(F.regexp_replace("x", r"\([A-Z]{2,6}\)", "")).alias("expansion"))
    fits = N.acronym_fits(F.lower("acronym"), N.significant_initials(N.fold(F.col("expansion"))))
    return p.where(fits).groupBy("acronym", "expansion").agg(F.count("*").alias("n")).where("n >= 2")


@R.query("project_promotions", f"""WITH {_NAMES}, x AS (SELECT DISTINCT {_FOLD.format('a.author')} AS name FROM documents_author a JOIN documents d USING (document_id) WHERE d.source_type = 'website')
SELECT name, CASE WHEN NOT regexp_matches(name, '[a-z0-9]{{2,}}') THEN 'initials_only' WHEN len(string_split(name, ' ')) < 2 THEN 'single_word' WHEN name NOT IN (SELECT name FROM x WHERE name IS NOT NULL) THEN 'no_page' WHEN len(string_split(name, ' ')) = 2 AND k >= 5 THEN 'shared_surname'
 WHEN last_year - first_year > 35 THEN 'career_span' WHEN divisions > 1 THEN 'several_divisions' END AS refusal FROM ev JOIN su ON su.surname = string_split(name, ' ')[-1]""")
def project_promotions(spark: SparkSession, sf: str) -> DataFrame:
    """As author_promotions, with a longer career, for names that a page and not only an attachment gives."""
    e = _evidence(spark, sf)
    surnames = e.groupBy(F.element_at(F.split("name", " "), -1).alias("surname")).agg(F.count("*").alias("n"))
    pages = table(spark, sf, "documents").where("source_type = 'website'").select("document_id").distinct()
    paged = table(spark, sf, "documents_author").where("author is not null").join(pages, "document_id", "left_semi").select(N.fold(F.col("author")).alias("name")).distinct().withColumn("paged", F.lit(True))
    return E.promotion(e.join(paged, "name", "left"), surnames, 5, 35, {"no_page": F.col("paged").isNull()}).select("name", "refusal")
