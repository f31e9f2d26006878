"""Sources and sinks of the corpus: nested API pages, HTML, stored tables with explicit schemas."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_REF = "struct<id:string,type:string>"
#: One page of a nested API: resources with attributes and references, and the resources they refer to.
PAGE_SCHEMA = f"data array<struct<id:string,type:string,attributes:map<string,string>,relationships:map<string,struct<data:array<{_REF}>>>>>, included array<struct<id:string,type:string,attributes:map<string,string>>>"


def read_api_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages, one JSON document per file."""
    return spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(path)


def api_records(pages: DataFrame, changed_since: str | None = None, published_only: bool = False, long_text: int = 200) -> DataFrame:
    """One row per resource: id, type, body (its long attributes), metadata (the others) and changed, filtered by time and state."""
    r = pages.select(F.explode("data").alias("r")).select("r.id", "r.type", "r.attributes")
    if changed_since is not None:
        r = r.where(F.element_at("attributes", "changed") >= changed_since)
    if published_only:
        r = r.where(F.lower(F.element_at("attributes", "status")).isin("true", "1"))
    entries = F.map_entries("attributes")
    body = F.array_join(F.transform(F.array_sort(F.filter(entries, lambda e: F.length(e["value"]) >= long_text)), lambda e: e["value"]), "\n\n")
    return r.select("id", "type", F.element_at("attributes", "changed").alias("changed"), body.alias("body"), F.map_from_entries(F.filter(entries, lambda e: F.length(e["value"]) < long_text)).alias("metadata"))


def api_references(pages: DataFrame) -> DataFrame:
    """id, field, target, label: every reference with the name or title of what it refers to, which may be on another page."""
    refs = pages.select(F.explode("data").alias("r")).select("r.id", F.explode("r.relationships").alias("field", "to")).select("id", "field", F.explode("to.data").alias("t")).select("id", "field", F.col("t.id").alias("target"), "t.type")
    known = pages.select(F.explode("included").alias("i")).select(F.col("i.id").alias("target"), "i.type", F.coalesce(F.element_at("i.attributes", "name"), F.element_at("i.attributes", "title")).alias("label"))
    known = known.groupBy("target", "type").agg(F.max("label").alias("label"))
    return refs.join(known, ["target", "type"], "left").select("id", "field", "target", "label").distinct()


class _Page(HTMLParser):
    """Text with block breaks, headed sections, links and tables of one HTML page."""

    BLOCKS = frozenset("p div section article li ul ol table tr br h1 h2 h3 h4 h5 h6 blockquote pre header footer".split())
    SILENT = frozenset(("script", "style", "noscript", "template"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.sections: list[list[str]] = [["", ""]]
        self.links: list[tuple[str, str]] = []
        self.silent = 0
        self.heading: list[str] | None = None
        self.anchor: list | None = None
        self.row: list[str] | None = None

    def add(self, s: str) -> None:
        self.out.append(s)
        self.sections[-1][1] += s

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SILENT:
            self.silent += 1
        elif tag in ("h1", "h2", "h3"):
            self.heading = []
            self.add("\n")
        elif tag == "a":
            self.anchor = [dict(attrs).get("href") or "", ""]
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
        elif tag in self.BLOCKS:
            self.add("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in ("h1", "h2", "h3") and self.heading is not None:
            title = " ".join("".join(self.heading).split())
            self.heading = None
            self.out.append(title + "\n")
            self.sections.append([title, ""])
        elif tag == "a" and self.anchor is not None:
            self.links.append((self.anchor[0], " ".join(self.anchor[1].split())))
            self.anchor = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.add("\n| " + " | ".join(" ".join(c.split()) for c in self.row) + " |")
            self.row = None
        elif tag in self.BLOCKS:
            self.add("\n")

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.anchor is not None:
            self.anchor[1] += data
        if self.heading is not None:
            self.heading.append(data)
        elif self.row:
            self.row[-1] += data
        else:
            self.add(data)


def _tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(" ".join(x.split()) for x in text.split("\n"))).strip()


def parse_html(markup: str | None) -> dict:
    """title, text, sections and links of a page; of empty markup, empty ones."""
    p = _Page()
    p.feed(markup or "")
    p.close()
    sections = [{"heading": h, "text": _tidy(t)} for h, t in p.sections]
    return {"title": next((s["heading"] for s in sections if s["heading"]), None), "text": _tidy("".join(p.out)), "sections": [s for s in sections if s["heading"] or s["text"]],
            "links": [{"href": html.unescape(h), "label": t} for h, t in dict.fromkeys(p.links) if h]}


def html_pages(df: DataFrame, key: str, markup: str) -> DataFrame:
    """key, title, text, sections (heading, text) and links (href, label) of HTML pages; null markup is an empty page."""
    section, link = pa.struct([("heading", pa.string()), ("text", pa.string())]), pa.struct([("href", pa.string()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [parse_html(x) for x in b.column("__m").to_pylist()]
            cols = [pa.array([p[c] for p in pages], t) for c, t in (("title", pa.string()), ("text", pa.string()), ("sections", pa.list_(section)), ("links", pa.list_(link)))]
            yield pa.RecordBatch.from_arrays([b.column(key), *cols], names=[key, "title", "text", "sections", "links"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(markup).alias("__m")).mapInArrow(run, f"{key} {kind}, title string, text string, sections array<struct<heading:string,text:string>>, links array<struct<href:string,label:string>>")


def pdf_links(markup: Column) -> Column:
    """The addresses of PDF files that a page's markup links to or names, each once, in order: from href attributes and bare ones."""
    found = F.regexp_extract_all(markup, F.lit(r"(?i)(?:href\s*=\s*[\"']([^\"'>]+?\.pdf(?:[?#][^\"'>]*)?)[\"']|(https?://[^\s<>\"']+?\.pdf)\b)"), F.lit(0))
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)^href\s*=\s*[\"']|[\"']$", ""), "&amp;", "&"))
    return F.array_distinct(plain)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, since: tuple[str, str] | None = None) -> DataFrame:
    """A stored table, with its columns and a lower bound of one pushed down to the files."""
    d = spark.read.parquet(path)
    if since is not None:
        d = d.where(F.col(since[0]) >= F.lit(since[1]).cast(d.schema[since[0]].dataType))
    return d.select(*columns) if columns else d


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A table written as parquet; with partitions, rows of one are brought together first so that files stay few."""
    w = df.repartition(*partition_by).write if partition_by else df.write
    (w.partitionBy(*partition_by) if partition_by else w).mode(mode).parquet(path)
