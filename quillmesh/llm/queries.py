"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.encoding import decode, encode
from quillmesh.llm.leakage import leaks
from quillmesh.llm.names import link_names, name_pairs
from quillmesh.llm.quality import fitted_profiles, text_statistics
from quillmesh.llm.scans import Repair, scanned_records
from quillmesh.llm.splitting import split_chunks
from quillmesh.plans.registry import Registry
from quillmesh.session import table

R = Registry()


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_chunks(table(spark, sf, "chunk"), table(spark, sf, "chunk_preset"))


@R.query("p1_found", r"""
SELECT c.chunk_id FROM (SELECT chunk_id, arg_max({'bundle': bundle, 'text': text}, indexed_at) AS r FROM chunk GROUP BY chunk_id) c
LEFT JOIN chunk_preset p ON p.preset = c.r.bundle
WHERE len(regexp_extract_all(c.r.text, '[^ \t\r\n]+')) > coalesce(p.child_max_tokens, (SELECT child_max_tokens FROM chunk_preset WHERE preset = 'default'))
""")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose current text was split."""
    return _pieces(spark, sf).select("chunk_id").distinct()


@R.query("p1_pieces")
def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of all current chunks over their limit."""
    return _pieces(spark, sf)


@R.query("p7_ids")
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k, without special tokens."""
    return encode(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


@R.query("p7_offsets")
def p7_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every document, with the code points at which each token starts and ends."""
    return encode(table(spark, sf, "documents").select("doc_id", "text"), offsets=True).select("doc_id", "ids", "starts", "ends")


@R.query("p7_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text encoded and decoded again."""
    return decode(encode(table(spark, sf, "documents").select("doc_id", "text"))).select("doc_id", F.col("decoded").alias("text"))


@R.query("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a quotation of a test item."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


@R.query("p8_quotations")
def p8_quotations(spark: SparkSession, sf: str) -> DataFrame:
    """As p8_found, with the field that leaked and the extent of the quotation."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def _statistics(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return text_statistics(docs, profiles=fitted_profiles(docs, table(spark, sf, "doc_labels")))


@R.query("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents most of whose characters are of a list, of a table or junk."""
    return _statistics(spark, sf).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind").distinct()


@R.query("p9_statistics")
def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of every document's text."""
    return _statistics(spark, sf).drop("text")


@R.query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different author values that name the same person or organisation."""
    return name_pairs(link_names(table(spark, sf, "documents_author")))


@R.query("p6_clusters")
def p6_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every different author value with its cluster and number of rows."""
    return link_names(table(spark, sf, "documents_author"))


@R.query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of scanned text that are page furniture, or hold a divided or a misread word."""
    return Repair(scanned_records(table(spark, sf, "pdf_evidence"), table(spark, sf, "table_data")), texts=False).found()


@R.query("p3_repaired")
def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The texts and tables repaired."""
    return Repair(scanned_records(table(spark, sf, "pdf_evidence"), table(spark, sf, "table_data"))).repaired()
