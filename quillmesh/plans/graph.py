"""Queries of typed relationships: orders are projects, led by customers, funded by suppliers; customers work in nations and belong to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import graph as G
from quillmesh.plans.registry import Registry
from quillmesh.session import table

R = Registry()

_CLAIMS = """claims AS (SELECT 'L' || o_orderkey AS claim_id, 'LED_BY' AS predicate, 'P' || o_orderkey AS subject_id, 'C' || o_custkey AS object_id, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'superseded' ELSE 'disputed' END AS status,
  CASE WHEN o_orderpriority < '3' THEN 'explicit' WHEN o_orderpriority < '4' THEN 'published' ELSE 'inferred' END AS basis, CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + 400 AS valid_until, 'D' || o_custkey AS document_id FROM orders
 UNION ALL SELECT 'F' || l_orderkey || '-' || l_linenumber, 'FUNDED_BY', 'P' || l_orderkey, 'S' || l_suppkey, CASE l_returnflag WHEN 'A' THEN 'superseded' ELSE 'active' END, CASE WHEN l_quantity > 25 THEN 'explicit' ELSE 'inferred' END, CAST(l_shipdate AS DATE), CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 300 END, 'D' || l_partkey FROM lineitem
 UNION ALL SELECT 'W' || c_custkey, 'WORKS_AT', 'C' || c_custkey, 'N' || c_nationkey, 'active', 'published', NULL, NULL, 'D' || c_custkey FROM customer
 UNION ALL SELECT 'M' || c_custkey, 'MEMBER_OF', 'C' || c_custkey, 'G' || c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'disputed' ELSE 'active' END, 'explicit', DATE '1995-01-01', NULL, 'D' || c_custkey FROM customer)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    o, li, c = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    day = lambda c: F.col(c).cast("date")
    k = lambda letter, *cols: F.concat(F.lit(letter), F.concat_ws("-", *(F.col(x).cast("string") for x in cols)))
    none = F.lit(None).cast("date")
    row = lambda df, *cols: df.select(*(x.alias(n) for x, n in zip(cols, ("claim_id", "predicate", "subject_id", "object_id", "status", "basis", "valid_from", "valid_until", "document_id"))))
    led = row(o, k("L", "o_orderkey"), F.lit("LED_BY"), k("P", "o_orderkey"), k("C", "o_custkey"), F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "superseded").otherwise("disputed"),
              F.when(F.col("o_orderpriority") < "3", "explicit").when(F.col("o_orderpriority") < "4", "published").otherwise("inferred"), day("o_orderdate"), F.date_add(day("o_orderdate"), 400), k("D", "o_custkey"))
    funded = row(li, k("F", "l_orderkey", "l_linenumber"), F.lit("FUNDED_BY"), k("P", "l_orderkey"), k("S", "l_suppkey"), F.when(F.col("l_returnflag") == "A", "superseded").otherwise("active"),
                 F.when(F.col("l_quantity") > 25, "explicit").otherwise("inferred"), day("l_shipdate"), F.when(F.col("l_linestatus") == "F", F.date_add(day("l_shipdate"), 300)), k("D", "l_partkey"))
    works = row(c, k("W", "c_custkey"), F.lit("WORKS_AT"), k("C", "c_custkey"), k("N", "c_nationkey"), F.lit("active"), F.lit("published"), none, none, k("D", "c_custkey"))
    member = row(c, k("M", "c_custkey"), F.lit("MEMBER_OF"), k("C", "c_custkey"), k("G", "c_mktsegment"), F.when(F.col("c_acctbal") < 0, "disputed").otherwise("active"), F.lit("explicit"), F.lit("1995-01-01").cast("date"), none, k("D", "c_custkey"))
    return led.unionByName(funded).unionByName(works).unionByName(member)


#: Of each kind of entity the ids that are asked for: those divisible by 50.
_ASKED = {"P": ("orders", "o_orderkey"), "C": ("customer", "c_custkey"), "S": ("supplier", "s_suppkey")}
_KINDS = {"projects_funded_by": "S", "leaders_of_funded": "S", "projects_led_by": "C", "works_at": "C", "member_of": "C", "funders_of": "P", "project_history": "P", "person_history": "C", "funding_history": "S", "by_subject": "P", "by_object": "C", "entity_timeline": "C"}
_LIMIT = 20
_WINDOW = {"window_start": "1996-01-01", "window_end": "1998-01-01"}


def _template_sql(name: str) -> str:
    t = G.TEMPLATES[name]
    at, key = _ASKED[_KINDS[name]]
    given = {"as_of": "1997-06-15"} if t.current else _WINDOW if name not in ("project_history", "person_history") else {}
    lo, hi = ("DATE '1997-06-15'", "DATE '1997-06-16'") if t.current else tuple(f"DATE '{given[n]}'" if n in given else "CAST(NULL AS DATE)" for n in ("window_start", "window_end"))
    names = "(" + ", ".join(f"'{p}'" for p in t.predicates) + ")"
    meets = f"((({lo}) IS NULL AND ({hi}) IS NULL) OR ((valid_from IS NOT NULL OR valid_until IS NOT NULL) AND (({hi}) IS NULL OR valid_from IS NULL OR valid_from < {hi}) AND (({lo}) IS NULL OR valid_until IS NULL OR valid_until > {lo})))"
    now = " AND status = 'active' AND basis IN ('explicit', 'published')" if t.current else ""
    take = lambda own, other: f"SELECT {own}_id AS entity_id, {other}_id AS other_id, claim_id, status, valid_from, valid_until, document_id FROM claims WHERE predicate IN {names} AND {meets}{now}"
    rows = take("subject", "object") if t.side == "subject" else take("object", "subject")
    if t.side == "either":
        rows += " UNION ALL " + take("subject", "object") + " AND (object_id IS NULL OR object_id <> subject_id)"
    if t.second:
        second = f"s AS (SELECT subject_id AS other_id, object_id AS second_other_id, claim_id AS second_claim_id FROM claims WHERE predicate = '{t.second}' AND {meets}{now}), j AS (SELECT r.*, second_other_id, second_claim_id FROM r JOIN s USING (other_id))"
    else:
        second = "j AS (SELECT *, CAST(NULL AS VARCHAR) AS second_other_id, CAST(NULL AS VARCHAR) AS second_claim_id FROM r)"
    return f"""WITH {_CLAIMS}, a AS (SELECT '{_KINDS[name]}' || {key} AS entity_id FROM {at} WHERE {key} % 50 = 0), r AS (SELECT * FROM ({rows}) WHERE entity_id IN (SELECT entity_id FROM a)), {second},
p AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(valid_until, DATE '9999-12-31') DESC, coalesce(valid_from, DATE '0001-01-01') DESC, claim_id, second_claim_id) AS position FROM j)
SELECT entity_id, CAST(position AS INTEGER) AS position, claim_id, other_id, second_claim_id, second_other_id, status, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_until AS VARCHAR) AS valid_until, document_id FROM p WHERE position <= {_LIMIT}"""


def _template(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        at, key = _ASKED[_KINDS[name]]
        asked = table(spark, sf, at).where(F.col(key) % 50 == 0).select(F.concat(F.lit(_KINDS[name]), F.col(key).cast("string")).alias("entity_id"))
        t = G.TEMPLATES[name]
        given = {"as_of": "1997-06-15"} if t.current else _WINDOW if name not in ("project_history", "person_history") else {}
        out = G.ask(name, _claims(spark, sf), asked, limit=_LIMIT, **given)
        return out.withColumn("valid_from", F.col("valid_from").cast("string")).withColumn("valid_until", F.col("valid_until").cast("string"))

    run.__name__ = f"graph_{name}"
    run.__doc__ = f"The question {name} for every {_ASKED[_KINDS[name]][0]} whose key is divisible by 50."
    return run


for _name in G.TEMPLATES:
    R.query(f"graph_{_name}", _template_sql(_name))(_template(_name))


_FUNCTIONAL = "(SELECT claim_id, subject_id, object_id, valid_from, valid_until FROM claims WHERE predicate = 'LED_BY')"


@R.query("claims_explained", f"""WITH {_CLAIMS}, v AS (SELECT a.claim_id AS x, b.claim_id AS y FROM claims a JOIN claims b ON a.predicate = 'FUNDED_BY' AND b.predicate = 'FUNDED_BY' AND a.subject_id = b.subject_id AND a.claim_id <> b.claim_id AND a.object_id <> b.object_id
 AND (a.valid_until IS NULL OR b.valid_from < a.valid_until) AND (b.valid_until IS NULL OR a.valid_from < b.valid_until)), n AS (SELECT x AS claim_id, count(DISTINCT y) AS n, min(y) AS lo, max(y) AS hi FROM v GROUP BY 1)
SELECT c.claim_id, c.predicate, c.subject_id, c.object_id, coalesce(n.n, 0) AS contradicted_by, n.lo AS first_against, n.hi AS last_against FROM claims c LEFT JOIN n USING (claim_id)""")
def claims_explained(spark: SparkSession, sf: str) -> DataFrame:
    """Every claim with what contradicts it: other funders of a project at the same time."""
    from quillmesh.operators.claims import overlapping_pairs

    c = _claims(spark, sf)
    pairs = overlapping_pairs(c.where("predicate = 'FUNDED_BY'").select("claim_id", "subject_id", "object_id", "valid_from", "valid_until"), ["subject_id"]).where("a.object_id <> b.object_id")
    return G.explain(c, pairs.select(F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"))).select("claim_id", "predicate", "subject_id", "object_id", "contradicted_by", "first_against", "last_against")


_DRAFTS = """e AS (SELECT document_id AS entity_id, CASE WHEN max(source_type) = 'website' THEN 'PROJECT' ELSE 'PERSON' END AS type, max(lang) = 'en' AS eligible FROM documents GROUP BY 1), t AS (SELECT chunk_id, min(text) AS text FROM chunk WHERE text IS NOT NULL GROUP BY 1),
d AS (SELECT DISTINCT chunk_id AS claim_id, CASE chunk_index % 4 WHEN 0 THEN 'AUTHORED' WHEN 1 THEN 'LED_BY' WHEN 2 THEN 'PARTNER_OF' ELSE upper(regexp_replace(section_type, '[^A-Za-z0-9]+', '_', 'g')) END AS predicate, document_id AS subject_id, CASE WHEN chunk_index % 4 = 1 THEN document_id END AS object_id,
 CASE WHEN chunk_index % 4 <> 1 THEN section_heading END AS object_text, document_id, CASE WHEN chunk_index % 5 < 4 THEN chunk_id END AS chunk_id, section_heading AS quote, strftime(indexed_at, '%Y-%m') AS valid_from, bundle AS valid_until, CASE WHEN chunk_index % 7 = 0 THEN 'rumour' ELSE 'published' END AS basis, 'active' AS status, token_count / 400.0 AS confidence FROM chunk)"""


@R.query("claim_codes", f"""WITH {_DRAFTS}, x AS (SELECT d.*, s.type AS st, s.eligible AS se, o.type AS ot, o.eligible AS oe, t.text, strpos(regexp_replace(trim(t.text), '\\s+', ' ', 'g'), regexp_replace(trim(quote), '\\s+', ' ', 'g')) AS place, predicate IN ('FUNDED_BY', 'PARTNER_OF', 'LED_BY', 'WORKS_AT', 'MEMBER_OF', 'PARENT_OF') AS linked, predicate = 'AUTHORED' AS literal
 FROM d LEFT JOIN e s ON s.entity_id = d.subject_id LEFT JOIN e o ON o.entity_id = d.object_id LEFT JOIN t ON t.chunk_id = d.chunk_id),
c AS (SELECT claim_id, CASE WHEN NOT coalesce(linked OR literal, false) THEN 'unknown_predicate' WHEN st IS NULL THEN 'unknown_subject' WHEN NOT se THEN 'subject_not_eligible' WHEN linked AND object_id IS NULL THEN 'missing_object_entity' WHEN linked AND ot IS NULL THEN 'unknown_object' WHEN linked AND NOT oe THEN 'object_not_eligible'
 WHEN linked AND trim(coalesce(object_text, '')) <> '' THEN 'object_text_on_entity_predicate' WHEN literal AND object_id IS NOT NULL THEN 'object_entity_on_text_predicate' WHEN literal AND trim(coalesce(object_text, '')) = '' THEN 'missing_object_text' WHEN literal AND length(trim(object_text)) > 255 THEN 'object_text_too_long'
 WHEN CASE predicate WHEN 'AUTHORED' THEN st <> 'PERSON' WHEN 'LED_BY' THEN st <> 'PROJECT' OR ot <> 'PERSON' WHEN 'PARTNER_OF' THEN st <> 'PROJECT' OR ot <> 'ORGANIZATION' END THEN 'type_violation' WHEN object_id = subject_id THEN 'self_reference' WHEN trim(coalesce(document_id, '')) = '' THEN 'missing_document'
 WHEN chunk_id IS NOT NULL AND text IS NULL THEN 'chunk_not_found' WHEN chunk_id IS NOT NULL AND trim(coalesce(quote, '')) = '' THEN 'missing_quote' WHEN chunk_id IS NOT NULL AND length(trim(quote)) NOT BETWEEN 12 AND 600 THEN 'quote_length' WHEN chunk_id IS NOT NULL AND place = 0 THEN 'quote_not_in_chunk' WHEN chunk_id IS NULL AND trim(coalesce(quote, '')) <> '' THEN 'quote_without_chunk'
 WHEN trim(coalesce(valid_until, '')) <> '' THEN 'bad_valid_until' WHEN basis <> 'published' THEN 'bad_basis' WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence_out_of_range' WHEN confidence < 0.2 THEN 'low_confidence' END AS code FROM x) SELECT coalesce(code, 'accepted') AS code, count(*) AS n FROM c GROUP BY 1""")
def claim_codes(spark: SparkSession, sf: str) -> DataFrame:
    """How often each reason speaks against a claim drafted from a chunk, and how many are accepted."""
    docs, ch = table(spark, sf, "documents"), table(spark, sf, "chunk")
    e = docs.groupBy(F.col("document_id").alias("entity_id")).agg(F.when(F.max("source_type") == "website", "PROJECT").otherwise("PERSON").alias("type"), (F.max("lang") == "en").alias("eligible"))
    texts = ch.where("text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    i = F.col("chunk_index")
    predicate = F.when(i % 4 == 0, "AUTHORED").when(i % 4 == 1, "LED_BY").when(i % 4 == 2, "PARTNER_OF").otherwise(G.predicate_name(F.col("section_type")))
    d = ch.select(F.col("chunk_id").alias("claim_id"), predicate.alias("predicate"), F.col("document_id").alias("subject_id"), F.when(i % 4 == 1, F.col("document_id")).alias("object_id"), F.when(i % 4 != 1, F.col("section_heading")).alias("object_text"), "document_id",
                  F.when(i % 5 < 4, F.col("chunk_id")).alias("chunk_id"), F.col("section_heading").alias("quote"), F.date_format("indexed_at", "yyyy-MM").alias("valid_from"), F.col("bundle").alias("valid_until"), F.when(i % 7 == 0, "rumour").otherwise("published").alias("basis"), F.lit("active").alias("status"), (F.col("token_count") / 400.0).alias("confidence")).distinct()
    return G.validate(d, e, texts, 0.2).groupBy(F.coalesce("code", F.lit("accepted")).alias("code")).agg(F.count("*").alias("n"))


@R.query("stale_claims", """WITH st AS (SELECT DISTINCT md5(document_id || '|' || theme) AS claim_id, document_id, theme_type AS field FROM documents_theme WHERE theme IS NOT NULL AND theme_type IS NOT NULL), fr AS (SELECT * FROM st WHERE claim_id < 'c') SELECT claim_id FROM st WHERE (document_id, field) IN (SELECT (document_id, field) FROM fr) AND claim_id NOT IN (SELECT claim_id FROM fr)""")
def stale_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims on themes of a document that a new reading of the document and field no longer has."""
    staged = table(spark, sf, "documents_theme").where("theme is not null and theme_type is not null").select(F.md5(F.concat_ws("|", "document_id", "theme")).alias("claim_id"), "document_id", F.col("theme_type").alias("field")).distinct()
    return G.stale_claims(staged.where("claim_id < 'c'"), staged)


@R.query("graph_checks", f"""WITH {_CLAIMS}, cur AS (SELECT * FROM claims WHERE status = 'active' AND basis IN ('explicit', 'published')), ed AS (SELECT * FROM claims WHERE basis = 'explicit'), en AS (SELECT 'P' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' UNION SELECT 'C' || c_custkey FROM customer),
k AS (SELECT predicate, count(*) AS n FROM cur GROUP BY 1), l AS (SELECT predicate, count(*) AS n FROM ed GROUP BY 1) SELECT 'edges:' || predicate AS check, coalesce(k.n, 0) AS expected, coalesce(l.n, 0) AS actual FROM k FULL JOIN l USING (predicate)
UNION ALL SELECT 'orphan_edges', 0, count(*) FROM ed WHERE subject_id NOT IN (SELECT id FROM en) UNION ALL SELECT 'edges_without_current_claim', 0, count(*) FROM ed WHERE claim_id NOT IN (SELECT claim_id FROM cur)""")
def graph_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Edges against the claims that they should come from, and invariants."""
    c = _claims(spark, sf)
    known = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("entity_id"))
    known = known.unionByName(table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id"))).distinct()
    return G.verify(c, c.where("basis = 'explicit'"), known)
