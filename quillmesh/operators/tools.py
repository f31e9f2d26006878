"""Guarded questions to the catalog: a result with its scope and whether it was cut, misses told from honest zeros."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import catalog as C

#: Groups of one and of two dimensions that a breakdown shows.
GROUPS, PAIRS = 20, 50
DIMENSIONS = ("bundle", "source_type", "year", "author", "theme")


@dataclasses.dataclass(frozen=True)
class Answer:
    """What a tool found: ok, miss (a name that the catalog lacks) or refused; rows, their scope, and if more exist."""

    outcome: str
    rows: DataFrame | None
    scope: C.Scope
    cut: bool = False
    missed: tuple[str, ...] = ()


def misses(catalog: C.Catalog, scope: C.Scope) -> tuple[str, ...]:
    """Names of a scope that no document has, so that nothing found there isn't an honest zero."""
    out = []
    if scope.bundle is not None and catalog.documents.where(F.col("bundle") == scope.bundle).limit(1).count() == 0:
        out.append("bundle")
    if scope.author is not None and catalog.authors.where(F.lower(C.author_key(catalog.authors)) == scope.author.lower()).limit(1).count() == 0:
        out.append("author")
    if scope.theme is not None and catalog.themes.where(F.lower("theme") == scope.theme.lower()).limit(1).count() == 0:
        out.append("theme")
    return tuple(out)


def count_records(catalog: C.Catalog, scope: C.Scope, count_of: str | None = None) -> Answer:
    """Documents of a scope, or different values of a dimension in it."""
    if count_of is not None and count_of not in DIMENSIONS:
        return Answer("refused", None, scope)
    if missed := misses(catalog, scope):
        return Answer("miss", None, scope, missed=missed)
    return Answer("ok", C.count_distinct_values(catalog, scope, count_of) if count_of else C.count_documents(catalog, scope), scope)


def list_records(catalog: C.Catalog, scope: C.Scope, limit: int = 20, offset: int = 0) -> Answer:
    """A page of a scope; one row more than asked for is fetched to know whether the page was cut."""
    if missed := misses(catalog, scope):
        return Answer("miss", None, scope, missed=missed)
    limit = min(C.PAGE, max(1, limit))
    page = C.list_documents(catalog, scope, limit, offset, more=1)
    rows = page.collect()  # a page and a row
    return Answer("ok", catalog.documents.sparkSession.createDataFrame(rows[:limit], page.schema), scope, cut=len(rows) > limit)


def aggregate_records(catalog: C.Catalog, scope: C.Scope, by: str, then_by: str | None = None) -> Answer:
    """A breakdown by one or two dimensions: all years in order, else the largest groups, with whether there are more."""
    if by not in DIMENSIONS or then_by is not None and then_by not in DIMENSIONS:
        return Answer("refused", None, scope)
    if missed := misses(catalog, scope):
        return Answer("miss", None, scope, missed=missed)
    if then_by is None and by == "year":
        return Answer("ok", C.distribution(catalog, scope, by).orderBy("key"), scope)
    most = GROUPS if then_by is None else PAIRS
    d = C.distribution(catalog, scope, by, most + 1) if then_by is None else C.cross_distribution(catalog, scope, by, then_by, most + 1)
    rows = d.collect()  # a group more than is shown
    return Answer("ok", catalog.documents.sparkSession.createDataFrame(rows[:most], d.schema), scope, cut=len(rows) > most)


def lookup_record(catalog: C.Catalog, title: str, limit: int = 20) -> tuple[Answer, str | None]:
    """The documents whose title contains a text, and the id of the document if there is one alone."""
    found = list_records(catalog, C.Scope(title_contains=title), limit)
    ids = {r.document_id for r in found.rows.select("document_id").collect()} if found.rows is not None else set()  # a page at most
    return found, next(iter(ids)) if len(ids) == 1 and not found.cut else None


def applied(scope: C.Scope) -> dict[str, object]:
    """The conditions that a scope sets."""
    return {f.name: v for f in dataclasses.fields(scope) if (v := getattr(scope, f.name)) not in (None, (), [])}


def project_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields asked for that a result has, in the order asked for; all without a request."""
    return df.select(*[f for f in fields if f in df.columns]) if fields else df


def is_guess(scope: C.Scope, rows: int) -> bool:
    """Whether an empty result hangs on a title that was only guessed, so that another way should be tried."""
    return rows == 0 and scope.title_contains is not None and not scope.topic_terms


def themes_by_group(catalog: C.Catalog) -> DataFrame:
    """``theme_group, theme``: the themes without a parent, each with its group or unclassified."""
    v = C.best_variants(catalog.themes)
    return v.where("parent is null").select(F.coalesce("theme_group", F.lit("unclassified")).alias("theme_group"), "theme")
