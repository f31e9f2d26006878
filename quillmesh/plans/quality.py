"""Queries of the general data-quality operators: hierarchies, differences between copies, instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import plain_name
from quillmesh.operators.differences import differences, latest, plain_number, plain_text, plain_version, uuid_key
from quillmesh.operators.hierarchy import closure, hierarchy
from quillmesh.operators.instants import instants
from quillmesh.plans.registry import Registry
from quillmesh.session import small, table

R = Registry()

_NAME = r"nullif(lower(trim(regexp_replace({}, '[\s\x{{00a0}}]+', ' ', 'g'))), '')"
_TREE = f"""
WITH RECURSIVE said AS (SELECT {_NAME.format('theme')} AS node, {_NAME.format('parent')} AS parent FROM documents_theme),
nodes AS (SELECT node, min(parent) AS parent FROM (SELECT node, parent FROM said UNION ALL SELECT parent, NULL FROM said) WHERE node IS NOT NULL GROUP BY node),
tree AS (SELECT node, parent, node AS root, [node] AS path FROM nodes WHERE parent IS NULL
         UNION ALL SELECT n.node, n.parent, t.root, list_append(t.path, n.node) FROM nodes n JOIN tree t ON n.parent = t.node)
"""


def _theme_tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "documents_theme").select("document_id", "theme", "theme_path", "depth", plain_name(F.col("theme")).alias("node"), plain_name(F.col("parent")).alias("parent"))
    return rows, hierarchy(rows.select("node", "parent"))


@R.query("p2_found", _TREE + f"""
SELECT DISTINCT d.document_id, d.theme FROM documents_theme d
JOIN nodes n ON n.node = {_NAME.format('d.theme')} LEFT JOIN tree t ON t.node = n.node
WHERE t.node IS NULL OR (d.theme_path IS NOT NULL AND (
  list_transform(string_split(d.theme_path, '>'), lambda x: coalesce({_NAME.format('x')}, '')) IS DISTINCT FROM t.path OR d.depth IS DISTINCT FROM len(t.path)))
""")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose theme never reaches a root, or whose stored path or depth is not the true one.

    A row with a null or blank theme is no case; a theme_path is compared name by name, a null depth differs.
    """
    rows, tree = _theme_tree(spark, sf)
    names = F.transform(F.split("theme_path", ">", -1), lambda x: F.coalesce(plain_name(x), F.lit("")))
    wrong = F.col("theme_path").isNotNull() & (~names.eqNullSafe(F.col("path")) | ~F.col("true_depth").eqNullSafe(F.col("depth")))
    # repeated rows go with the last distinct, after most rows were found to be right
    return (rows.join(small(tree.select("node", "rooted", "path", F.col("depth").alias("true_depth"))), "node")
            .where(~F.col("rooted") | wrong).select("document_id", "theme").distinct())


@R.query("p2_tree", _TREE + """
SELECT n.node AS theme, n.parent, t.node IS NOT NULL AS rooted, t.root, CAST(len(t.path) AS INTEGER) AS depth, array_to_string(t.path, ' > ') AS theme_path,
  CASE WHEN t.node IS NOT NULL THEN (SELECT count(*) FROM tree u WHERE list_contains(u.path, n.node)) - 1 END AS descendants
FROM nodes n LEFT JOIN tree t ON t.node = n.node
""")
def p2_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Every theme with its parent, root, depth, full path and number of descendants."""
    return _theme_tree(spark, sf)[1].select(F.col("node").alias("theme"), "parent", "rooted", "root", "depth", F.array_join("path", " > ").alias("theme_path"), "descendants")


@R.query("p2_descendants", _TREE + """
SELECT a.anc AS ancestor, a.node AS descendant, CAST(len(a.path) - list_position(a.path, a.anc) AS INTEGER) AS distance
FROM (SELECT node, path, unnest(path) AS anc FROM tree) a WHERE a.anc <> a.node
""")
def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every theme with each of its descendants."""
    return closure(_theme_tree(spark, sf)[1])


_FIELDS = ["doc_version", "pipeline_version", "content_hash", "bundle"]


def _state(spark: SparkSession, sf: str, name: str) -> DataFrame:
    plain = table(spark, sf, name).select(
        uuid_key(F.col("document_id")).alias("document_id"), "indexed_at", plain_number(F.col("doc_version")).alias("doc_version"),
        plain_version(F.col("pipeline_version")).alias("pipeline_version"), plain_text(F.col("content_hash")).alias("content_hash"), plain_text(F.col("bundle")).alias("bundle"))
    return latest(plain, "document_id", _FIELDS, "indexed_at")


def _state_sql(name: str) -> str:
    text = "nullif(lower(trim(CAST({} AS VARCHAR), ' \t\n\r')), '')"
    version = f"nullif(regexp_replace({text}, '^v\\s*', ''), '')"
    bare = f"replace({text.format('document_id')}, '-', '')"
    return f"""SELECT document_id, unnest(arg_max(s, (indexed_at, s)), recursive := true) FROM (
      SELECT CASE WHEN length({bare}) = 32 THEN concat_ws('-', {bare}[1:8], {bare}[9:12], {bare}[13:16], {bare}[17:20], {bare}[21:32]) ELSE {bare} END AS document_id, indexed_at,
        {{'doc_version': coalesce(CAST(CAST(TRY_CAST({version.format('doc_version')} AS DOUBLE) AS BIGINT) AS VARCHAR), {version.format('doc_version')}), 'pipeline_version': {version.format('pipeline_version')},
         'content_hash': {text.format('content_hash')}, 'bundle': {text.format('bundle')}}} AS s FROM {name})
    WHERE document_id IS NOT NULL GROUP BY document_id"""


_STATES = f"WITH a AS ({_state_sql('state_record')}), b AS ({_state_sql('state_replica')})"


@R.query("p4_found", _STATES + """
SELECT coalesce(a.document_id, b.document_id) AS document_id, unnest(list_filter([
  CASE WHEN b.document_id IS NULL THEN 'missing_in_replica' END, CASE WHEN a.document_id IS NULL THEN 'missing_in_catalog' END,
""" + ",\n".join(f"CASE WHEN a.document_id IS NOT NULL AND b.document_id IS NOT NULL AND a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in _FIELDS) + """
], lambda x: x IS NOT NULL)) AS difference FROM a FULL JOIN b ON a.document_id = b.document_id
""")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents missing in the catalog or its replica, and fields in which the two differ."""
    return differences(_state(spark, sf, "state_record"), _state(spark, sf, "state_replica"), "document_id", _FIELDS, "catalog", "replica").select("document_id", "difference")


@R.query("p4_differences", _STATES + ", d AS (" + " UNION ALL ".join(
    f"SELECT a.document_id, '{f}' AS difference, a.{f} AS catalog_value, b.{f} AS replica_value FROM a JOIN b ON a.document_id = b.document_id WHERE a.{f} IS DISTINCT FROM b.{f}" for f in _FIELDS) + """
 UNION ALL SELECT document_id, 'missing_in_replica', NULL, NULL FROM a WHERE document_id NOT IN (SELECT document_id FROM b)
 UNION ALL SELECT document_id, 'missing_in_catalog', NULL, NULL FROM b WHERE document_id NOT IN (SELECT document_id FROM a)) SELECT * FROM d""")
def p4_differences(spark: SparkSession, sf: str) -> DataFrame:
    """As p4_found, with the values of both sides as they were compared."""
    d = differences(_state(spark, sf, "state_record"), _state(spark, sf, "state_replica"), "document_id", _FIELDS, "catalog", "replica")
    return d.withColumnsRenamed({"left_value": "catalog_value", "right_value": "replica_value"})


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """One row per different value of the four date columns."""
    pdf = table(spark, sf, "pdf_evidence").select("document_id", "tz_name", F.inline(F.array(
        *(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("pdf_created", "pdf_modified", "file_created")))))
    node = table(spark, sf, "date_candidates").select("document_id", "tz_name", F.lit("node_created").alias("field"), F.col("node_created").alias("value"))
    return pdf.unionByName(node).where("value is not null").distinct()


@R.query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the four date columns that names a real date, as whole seconds since 1970."""
    return instants(_dated(spark, sf)).where("instant is not null").select("document_id", "field", "epoch_s").distinct()


@R.query("p5_instants")
def p5_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Every different value of the four date columns with its instant, precision and how its zone was found."""
    return instants(_dated(spark, sf))
