"""The catalog: documents with facets, counted, listed and broken down under one scope.

One predicate builder serves every operation, so that a count, a listing and a breakdown of the same scope agree.
Facet conditions are semi joins, which never multiply documents.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Scope:
    """What documents an operation is about; unset fields don't constrain. The date range is half open."""

    source_type: str | None = None
    bundle: str | None = None
    title_contains: str | None = None
    topic_terms: Sequence[str] = ()
    author: str | None = None
    theme: str | None = None
    theme_group: str | None = None
    effective_from: str | None = None
    effective_to: str | None = None
    #: A pattern of LIKE on the title, and values of which a document must have one.
    title_like: str | None = None
    entity_type: str | None = None
    authors_any: Sequence[str] = ()
    tags_any: Sequence[str] = ()


@dataclasses.dataclass(frozen=True)
class Catalog:
    """The tables: documents (document_id, title, bundle, source_type, effective_start_date, indexed_at), authors, themes, tags (document_id, tag)."""

    documents: DataFrame
    authors: DataFrame
    themes: DataFrame
    tags: DataFrame | None = None


def contains(column: Column, term: str) -> Column:
    """Case-insensitive containment, with the wildcards of LIKE taken literally."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def author_key(authors: DataFrame) -> Column:
    """The stored normal form of an author, else the name as typed."""
    return F.coalesce(F.col("author_norm"), F.col("author"))


def in_scope(catalog: Catalog, scope: Scope) -> DataFrame:
    """The documents of a scope, each once."""
    d = catalog.documents
    for column, value in (("source_type", scope.source_type), ("bundle", scope.bundle), ("entity_type", scope.entity_type)):
        if value is not None:
            d = d.where(F.col(column) == value)
    if scope.title_contains:
        d = d.where(contains(F.col("title"), scope.title_contains))
    if scope.title_like is not None:
        d = d.where(F.lower("title").like(scope.title_like.lower()))
    if scope.topic_terms:
        d = d.where(matched_terms(F.col("title"), scope.topic_terms) > 0)
    if scope.effective_from is not None:
        d = d.where(F.col("effective_start_date") >= F.lit(scope.effective_from).cast("date"))
    if scope.effective_to is not None:
        d = d.where(F.col("effective_start_date") < F.lit(scope.effective_to).cast("date"))
    if scope.author is not None:
        d = d.join(catalog.authors.where(F.lower(author_key(catalog.authors)) == scope.author.lower()).select("document_id"), "document_id", "left_semi")
    if scope.authors_any:
        named = F.lower(author_key(catalog.authors)).isin(*(a.lower() for a in scope.authors_any))
        d = d.join(catalog.authors.where(named).select("document_id"), "document_id", "left_semi")
    if scope.tags_any:
        if catalog.tags is None:
            raise ValueError("this catalog has no tags")  # refused, never ignored
        d = d.join(catalog.tags.where(F.lower("tag").isin(*(t.lower() for t in scope.tags_any))).select("document_id"), "document_id", "left_semi")
    if scope.theme is not None or scope.theme_group is not None:
        t = catalog.themes
        if scope.theme is not None:
            t = t.where(F.lower("theme") == scope.theme.lower())  # a theme is never widened to its descendants
        if scope.theme_group is not None:
            t = t.where(F.col("theme_group") == scope.theme_group)
        d = d.join(t.select("document_id"), "document_id", "left_semi")
    return d


def matched_terms(title: Column, terms: Sequence[str]) -> Column:
    """How many of the terms a title contains."""
    hits = [F.coalesce(contains(title, t), F.lit(False)).cast("int") for t in terms]
    out = F.lit(0)
    for h in hits:
        out = out + h
    return out


def count_documents(catalog: Catalog, scope: Scope) -> DataFrame:
    return in_scope(catalog, scope).agg(F.count("*").alias("documents"))


def widened_counts(catalog: Catalog, scope: Scope) -> DataFrame:
    """``scope, documents``: how many a scope has, and how many without its period and without its type, in one result."""
    scopes = {"asked": scope, "without_period": dataclasses.replace(scope, effective_from=None, effective_to=None), "without_type": dataclasses.replace(scope, source_type=None, bundle=None, entity_type=None)}
    counts = [count_documents(catalog, s).select(F.lit(n).alias("scope"), "documents") for n, s in scopes.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def unique_titles(documents: DataFrame) -> DataFrame:
    """``title, document_id, documents``: titles, trimmed and in lower case, with the document if only one has it. Blank and null titles are left out."""
    # least and greatest tell one from several, so that no ids are gathered
    t = documents.select(F.lower(F.trim("title")).alias("title"), "document_id").where("title <> ''")
    one = F.when(F.min("document_id") == F.max("document_id"), F.min("document_id"))
    return t.groupBy("title").agg(one.alias("document_id"), F.countDistinct("document_id").alias("documents"))


#: Documents of a page, at most.
PAGE = 100


def list_documents(catalog: Catalog, scope: Scope, limit: int = 20, offset: int = 0, more: int = 0) -> DataFrame:
    """A page of a scope: most topic terms first, then the newest, undated last, then by id. The limit is 1 to PAGE; ``more`` rows beyond it tell whether others follow."""
    d = in_scope(catalog, scope).select("document_id", "title", "bundle", "effective_start_date", matched_terms(F.col("title"), scope.topic_terms).alias("matched"))
    page = d.orderBy(F.desc("matched"), F.col("effective_start_date").desc_nulls_last(), "document_id")
    return page.offset(max(0, offset)).limit(min(PAGE, max(1, limit)) + more)


def _dimension(catalog: Catalog, dimension: str, scoped: DataFrame) -> DataFrame:
    """document_id and the dimension's key, a row for each of a document's keys."""
    if dimension == "bundle":
        return scoped.select("document_id", F.col("bundle").alias("key"))
    if dimension == "source_type":
        return scoped.select("document_id", F.col("source_type").alias("key"))
    if dimension == "year":
        return scoped.select("document_id", F.year("effective_start_date").cast("string").alias("key"))
    if dimension == "author":
        facet = catalog.authors.select("document_id", author_key(catalog.authors).alias("key"))
    elif dimension == "theme":
        facet = catalog.themes.select("document_id", F.col("theme").alias("key"))
    else:
        raise ValueError(f"unknown dimension {dimension}")  # refused, never defaulted
    return facet.join(scoped.select("document_id"), "document_id").distinct()


def distribution(catalog: Catalog, scope: Scope, dimension: str, limit: int | None = None) -> DataFrame:
    """Documents per key of a dimension, most first; documents without a key take a place of the limit, then are dropped."""
    d = _dimension(catalog, dimension, in_scope(catalog, scope)).groupBy("key").agg(F.countDistinct("document_id").alias("documents"))
    if limit is not None:
        d = d.orderBy(F.desc("documents"), F.col("key").asc_nulls_first()).limit(limit)
    return d.where("key is not null")


def cross_distribution(catalog: Catalog, scope: Scope, first: str, second: str, limit: int | None = None) -> DataFrame:
    """Documents per pair of keys of two dimensions; pairs with a missing key are dropped after the limit."""
    scoped = in_scope(catalog, scope)
    a = _dimension(catalog, first, scoped).withColumnRenamed("key", "key_a")
    b = _dimension(catalog, second, scoped).withColumnRenamed("key", "key_b")
    d = a.join(b, "document_id").groupBy("key_a", "key_b").agg(F.countDistinct("document_id").alias("documents"))
    if limit is not None:
        d = d.orderBy(F.desc("documents"), F.col("key_a").asc_nulls_first(), F.col("key_b").asc_nulls_first()).limit(limit)
    return d.where("key_a is not null and key_b is not null")


def count_distinct_values(catalog: Catalog, scope: Scope, dimension: str) -> DataFrame:
    return _dimension(catalog, dimension, in_scope(catalog, scope)).agg(F.countDistinct("key").alias("n_values"))


def best_variants(themes: DataFrame) -> DataFrame:
    """The vocabulary of themes: of the ways a theme is stored, the one on most documents, ties by its values."""
    keys = ["theme_group", "theme_type", "parent", "theme_path", "depth"]
    counted = themes.where("theme is not null").groupBy("theme", *keys).agg(F.countDistinct("document_id").alias("documents"))
    # an aggregation, so that a theme with many variants is summed up before it is shuffled; nulls are the least
    best = F.max(F.struct("documents", *keys)).alias("best")
    return counted.groupBy("theme").agg(best).select("theme", *(F.col(f"best.{k}").alias(k) for k in [*keys, "documents"]))


def facet_lists(catalog: Catalog, document_ids: DataFrame) -> DataFrame:
    """Authors and primary themes of some documents, as sorted arrays; documents without any have empty ones."""
    lists = lambda df, c, name: df.join(document_ids, "document_id", "left_semi").groupBy("document_id").agg(F.array_sort(F.collect_set(c)).alias(name))
    out = document_ids.select("document_id").distinct()
    out = out.join(lists(catalog.authors, "author", "authors"), "document_id", "left")
    out = out.join(lists(catalog.themes.where("theme_type = 'primary'"), "theme", "themes"), "document_id", "left")
    return out.select("document_id", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("authors", "themes")))
