"""Mentions of names in texts: dictionary spans, and their resolution to the longest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import let
from quillmesh.session import Scratch, small

#: Runs of up to so many words are built by zipping, longer ones by slices, lest the plan grows with the names.
ZIPPED = 6


def words(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " "), lambda w: w != "")


def _joined(w: Column, k: int):
    return lambda _, i: F.array_join(F.slice(w, i + 1, F.lit(k)), " ")


def spans(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key, start, length, name, kind for every place where a name stands, by words; names: name, kind.

    Runs of as many words as names have are joined with the names, so the dictionary may be of any size; sizes that no
    name has are not built. Null and blank names are left out.
    """
    n = names.where("name is not null").select("name", "kind", words(F.col("name")).alias("w")).withColumn("length", F.size("w"))
    n = Scratch(df.sparkSession, "names").write(n.where(F.col("length") >= 1).select(F.array_join("w", " ").alias("run"), "length", "name", "kind").distinct())
    sizes = [r[0] for r in n.select("length").distinct().collect()]  # as many as names have lengths
    if not sizes:
        return df.select(key, F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("name"), F.lit("").alias("kind")).limit(0)

    def at(out: Column, k: int) -> Column:
        return F.transform(out, lambda r, i: F.struct(i.alias("start"), F.lit(k).alias("length"), r.alias("run")))

    def runs(w: Column) -> Column:
        parts = []
        for k in sorted(sizes):
            size = F.greatest(F.size(w) - (k - 1), F.lit(0))
            out = F.slice(w, 1, size)
            if k > ZIPPED:
                out = F.transform(out, _joined(w, k))
            for i in range(1, k if k <= ZIPPED else 1):
                out = F.zip_with(out, F.slice(w, 1 + i, size), lambda a, b: F.concat_ws(" ", a, b))
            parts.append(at(out, k))
        return F.concat(*parts)

    d = df.where(F.col(text).isNotNull()).select(key, F.inline(let(words(F.col(text)), runs)))
    # runs stay where they are if the names can be broadcast
    return d.join(small(n), ["run", "length"]).select(key, "start", "length", "name", "kind")


def outermost(found: DataFrame, key: str) -> DataFrame:
    """Spans that no longer span of the same text holds; equal spans of several names all stay.

    Each span is compared with those that hold its place, by an equi-join on the text and the place.
    """
    longer = found.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("length").alias("__l")).distinct().where("__l > 1")
    covers = longer.select("__k", "__s", "__l", F.explode(F.sequence(F.col("__s"), F.col("__s") + F.col("__l") - 1)).alias("start"))
    inside = (found[key] == covers["__k"]) & (found["start"] == covers["start"]) & (covers["__l"] > found["length"]) & (found["start"] + found["length"] <= covers["__s"] + covers["__l"])
    return found.join(covers, inside, "left_anti")


def disjoint(found: DataFrame, key: str) -> DataFrame:
    """Spans of which no two of a text share a word: the longest first, then the first, then the least name. found: key, start, length, name, kind.

    Spans are sorted within their text and read once; the places taken of one text are in memory at a time.
    """
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = None, set()
        for b in batches:
            kept = []
            for i, (k, start, length) in enumerate(zip(b.column(key).to_pylist(), b.column("start").to_pylist(), b.column("length").to_pylist())):
                if (k,) != at:
                    at, taken = (k,), set()
                places = range(start, start + length)
                if taken.isdisjoint(places):
                    taken.update(places)
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int64()))

    return found.distinct().repartition(key).sortWithinPartitions(key, F.desc("length"), "start", "name", "kind").select(*names).mapInArrow(run, found.schema)
