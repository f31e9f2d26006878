"""Evaluation texts that leaked into a corpus: approximate passages by the pigeonhole principle.

A quotation of at least 12 words with at most one word in five changed holds a window of 12 words with at most 2
changes, of 15 with at most 3, or of 20 with at most 4. Such a window, cut into one piece more than its changes, has
a piece that stands in the document unchanged. All pieces of all test items make an index; a document's exact hits
are sought there, and the windows around them are verified by Myers' bit-parallel edit distance over words.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.session import Scratch

#: (words of a window, changes allowed in it). A quotation of 24 words or more holds one of 12 or more within the same share of changes.
WINDOWS = ((12, 2), (15, 3), (20, 4))
#: Words of the shortest piece of any window: 15 words in 4 pieces.
PIECE = 3
#: Runs of PIECE words that any window keeps: its words but for the changes, less two for each of its pieces.
HITS = min(w - k - (PIECE - 1) * (k + 1) for w, k in WINDOWS)
#: Words beyond a window that are looked at to tell a quotation from a sentence built alike.
BEYOND = 8
#: Test items whose index is in memory at once; more are taken in blocks, each with its own pass over the corpus.
ITEMS_PER_BLOCK = 20_000

_words = re.compile("[^\\W_]+(?:[-‐‑'’][^\\W_]+)*").findall
_inner = re.compile("[-‐‑'’]")
_unseen = re.compile("[­​-‏⁠﻿]")


def words(text: str | None) -> list[str]:
    """The words of a text, without regard to case, punctuation, spacing and compatibility forms of characters.

    Hyphens and apostrophes within a word are left out, so that it stays one word.
    """
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _unseen.sub("", text))
    return [w if w.isalnum() else _inner.sub("", w) for w in _words(text.lower())]


def myers(pattern: Sequence[int], text: Sequence[int], most: int) -> tuple[int, int] | None:
    """The least edit distance of the pattern to any part of the text, and where that part ends; None if over ``most``."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = (m, 0) if m <= most else (most + 1, -1)
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a part may begin anywhere in the text
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= most else None


class Index:
    """The pieces of a block of test items."""

    def __init__(self, items: list[tuple[int, str, str]], shared: frozenset[str] = frozenset()):
        """shared: runs of the block that different texts of other blocks have as well."""
        self.names = [(i, f) for i, f, _ in items]
        self.ids: dict[str, int] = {}
        self.texts = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(t)], np.int64) for _, _, t in items]
        self.base = len(self.ids) + 1
        #: Words of four letters or more; shorter ones are equal by chance too often.
        self.telling = [False, *(len(w) > 3 for w in self.ids)]
        keys, item, pos = [], [], []
        for n, t in enumerate(self.texts):
            if len(t) >= WINDOWS[0][0]:
                k = self.keys(t)
                keys.append(k)
                item.append(np.full(len(k), n))
                pos.append(np.arange(len(k)))
        none = np.zeros(0, np.int64)
        keys, item, pos = (np.concatenate(x) if x else none for x in (keys, item, pos))
        order = np.argsort(keys, kind="stable")
        self.keys_, self.item, self.pos = keys[order], item[order], pos[order]
        # copies of a text count once
        first: dict[bytes, int] = {}
        copy = np.array([first.setdefault(t.tobytes(), n) for n, t in enumerate(self.texts)], np.int64)
        held = np.unique(np.stack([self.keys_, copy[self.item]]), axis=1)[0] if len(self.keys_) else self.keys_
        runs, many = np.unique(held, return_counts=True)
        single = runs[many == 1]
        said = [None, *self.ids]
        #: Runs that no different text of the items has, by item and position.
        self.own = [np.isin(self.keys(t), single) for t in self.texts]
        for t, own in zip(self.texts, self.own):
            for at in np.flatnonzero(own) if shared else ():
                own[at] = " ".join(said[w] for w in t[at : at + PIECE]) not in shared

    def keys(self, t: np.ndarray) -> np.ndarray:
        """A number for every run of PIECE words."""
        if len(t) < PIECE:
            return np.zeros(0, np.int64)
        k = np.zeros(len(t) - PIECE + 1, np.int64)
        for i in range(PIECE):
            k = k * self.base + t[i : len(t) - PIECE + 1 + i]
        return k

    def seeds(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact hits: item, position in the item, position in the text."""
        k = self.keys(t)
        lo, hi = np.searchsorted(self.keys_, k, "left"), np.searchsorted(self.keys_, k, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(k)), n)
        idx = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return self.item[idx], self.pos[idx], at

    def leaks(self, t: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, words, changes) of every item that the document holds."""
        out = []
        items, pos, at = self.seeds(t)
        order = np.lexsort((pos, at - pos, items))
        items, pos, at = items[order], pos[order], at[order]
        cuts = np.flatnonzero(np.diff(items)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(items)]):
            if b - a >= HITS and (found := self._verify(self.texts[items[a]], self.own[items[a]], t, pos[a:b], at[a:b]) or _verbatim(pos[a:b], at[a:b])):
                out.append((int(items[a]), *found))
        return out

    def _verify(self, p: np.ndarray, own: np.ndarray, t: np.ndarray, pos: np.ndarray, at: np.ndarray) -> tuple[int, int] | None:
        done: set[tuple[int, int]] = set()
        slack = WINDOWS[-1][1]
        diagonals = at - pos  # in order
        for diagonal in np.unique(diagonals):
            if np.searchsorted(diagonals, diagonal + slack, "right") - np.searchsorted(diagonals, diagonal - slack) < HITS:
                continue
            here = slice(np.searchsorted(diagonals, diagonal), np.searchsorted(diagonals, diagonal, "right"))
            # words of the item that stand in the document near this diagonal
            near = np.zeros(len(p), bool)
            for d in range(diagonal - slack, diagonal + slack + 1):
                lo, hi = max(0, -d), min(len(p), len(t) - d)
                if lo < hi:
                    near[lo:hi] |= p[lo:hi] == t[lo + d : hi + d]
            total = np.concatenate(([0], np.cumsum(near)))
            hit = np.zeros(len(p) + 1, np.int64)
            hit[pos[here]] = 1
            hits = np.concatenate(([0], np.cumsum(hit)))
            for w, k in WINDOWS:
                if len(p) < w:
                    continue
                starts = np.arange(len(p) - w + 1)
                good = (total[w:] - total[:-w] >= w - k) & (hits[starts + w - PIECE + 1] - hits[starts] > 0)
                for s in np.flatnonzero(good):
                    lo = max(0, s + diagonal - slack - k)
                    if (s * 64 + w, lo) in done:
                        continue
                    done.add((s * 64 + w, lo))
                    text = t[lo : s + diagonal + w + slack + k].tolist()
                    r = myers(p[s : s + w].tolist(), text, k)
                    if r and (whole := self._whole(p, t, int(s), w, lo + r[1], k)):
                        a, n, changes = whole
                        # so short and yet changed, it must have a run of its own, not only phrases that several items share
                        kept = pos[np.searchsorted(diagonals, diagonal - k) : np.searchsorted(diagonals, diagonal + k, "right")]
                        if n >= WINDOWS[1][0] or not changes or own[kept[(kept >= a) & (kept <= a + n - PIECE)]].any():
                            return n, changes
        return None

    def _whole(self, p: np.ndarray, t: np.ndarray, s: int, w: int, end: int, most: int) -> tuple[int, int, int] | None:
        """The quotation in and around a verified window that ends at ``end`` of the text, from its first equal word to its last.

        None if that is too short or changed too much, or if the text beyond it goes on like the item.
        """
        lo = max(0, end - w - most)
        inside = [(s + i, lo + j) for i, j in _equal(p[s : s + w].tolist(), t[lo:end].tolist())]
        first, last = inside[0], inside[-1]
        right = _follow(p[last[0] + 1 : last[0] + 1 + BEYOND].tolist(), t[last[1] + 1 : last[1] + 2 + BEYOND].tolist())
        left = _follow(p[max(0, first[0] - BEYOND) : first[0]][::-1].tolist(), t[max(0, first[1] - BEYOND - 1) : first[1]][::-1].tolist())
        before = [(first[0] - 1 - i, first[1] - 1 - j) for i, j in left]
        after = [(last[0] + 1 + i, last[1] + 1 + j) for i, j in right]
        telling = sum(self.telling[p[i]] for i, _ in before + after)
        spans = [((before or [first])[-1], (after or [last])[-1])]
        if telling < 2:  # what follows may be like the item by chance
            spans += [(first, (after or [last])[-1]), ((before or [first])[-1], last), (first, last)]
        for (a, x), (b, y) in spans:
            n = b - a + 1
            if n >= WINDOWS[0][0] and (r := myers(p[a : b + 1].tolist(), t[x : y + 1].tolist(), n // 5)):
                return a, n, r[0]
        return None


def _verbatim(pos: np.ndarray, at: np.ndarray) -> tuple[int, int] | None:
    """The longest unchanged quotation among hits in order of diagonal and place, whatever stands around it."""
    cuts = np.flatnonzero((np.diff(pos) != 1) | (np.diff(at) != 1)) + 1
    n = int(np.diff(np.concatenate(([0], cuts, [len(pos)]))).max()) + PIECE - 1
    return (n, 0) if n >= WINDOWS[0][0] else None


def _equal(p: list[int], t: list[int]) -> list[tuple[int, int]]:
    """Pairs of equal words in an alignment of all of p with an end of t."""
    rows = [[0] * (len(t) + 1)]
    for i, x in enumerate(p, 1):
        prev, cur = rows[-1], [i]
        for j, y in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        rows.append(cur)
    out, i, j = [], len(p), len(t)
    while i and j:
        if rows[i][j] == rows[i - 1][j - 1] + (p[i - 1] != t[j - 1]):
            i, j = i - 1, j - 1
            if p[i] == t[j]:
                out.append((i, j))
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _follow(p: list[int], t: list[int]) -> list[tuple[int, int]]:
    """Words of p that t has in the same order, each within a place of where the one before puts it."""
    out: list[tuple[int, int]] = []
    drift = after = 0
    for i, w in enumerate(p):
        for d in (0, 1, -1):
            j = i + drift + d
            if after <= j < len(t) and t[j] == w:
                out.append((i, j))
                drift, after = drift + d, j + 1
                break
    return out


_built: dict[str, Index] = {}


def _index(token: str, items: list[tuple[int, str, str]], shared: frozenset[str]) -> Index:
    """The index of a block, built once per worker process; one block's index is kept at a time."""
    if token not in _built:
        _built.clear()
        _built[token] = Index(items, shared)
    return _built[token]


def _shared(items: DataFrame, item: str, fields: Sequence[str], blocks: int) -> DataFrame:
    """(block, run): runs that different texts of the items have, in each block that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, " ".join(w[i : i + PIECE]), " ".join(w)) for n, t in zip(*(b.column(c).to_pylist() for c in ("block", "text"))) if len(w := words(t)) >= WINDOWS[0][0] for i in range(len(w) - PIECE + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))], names=["block", "run", "text"])

    texts = items.select(F.pmod(F.xxhash64(item), F.lit(blocks)).cast("long").alias("block"), F.explode(F.array(*fields)).alias("text")).where("text is not null")
    runs = texts.mapInArrow(run, "block long, run string, text string").select("block", "run", F.xxhash64("text").alias("text"))
    several = runs.groupBy("run").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("run")
    return runs.select("block", "run").distinct().join(several, "run")


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", fields: Sequence[str] = ("question", "passage")) -> DataFrame:
    """Documents that hold a quotation of a test item: ``key``, ``item``, ``field``, ``words``, ``changes``, one row per pair and field.

    A quotation is 12 or more words in sequence from the field, with at most one word in five exchanged, dropped or
    added; case, punctuation, spacing and line breaks don't count. Where the text around it goes on like the item but
    the whole then has more changes than that, it is a sentence built alike and no quotation, unless 12 words in sequence
    are unchanged. words and changes are of
    the first quotation that was verified. Whole texts are searched, without a bound on hits or items.

    Null and empty texts hold nothing, and null fields or ones under 12 words are not held; rows with equal keys are
    searched each and may give equal rows. Items are read in blocks of about ITEMS_PER_BLOCK, one pass over the
    documents each. Other columns of either frame are ignored.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType
    docs = documents.select(F.col(key), F.col(text).alias("__text")).where("__text <> ''")
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    schema = T.StructType([T.StructField(key, kind), T.StructField("__n", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("changes", T.IntegerType())])
    out = None
    keep = Scratch(spark, "leaks")
    several = keep.write(_shared(items, item, fields, blocks)) if blocks > 1 else None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b).select(item, *fields).collect()
        block = [(r[item], f, r[f]) for r in rows for f in fields if r[f]]
        other = frozenset(r.run for r in several.where(F.col("block") == b).toLocalIterator()) if several is not None else frozenset()
        shared, token = spark.sparkContext.broadcast((block, other)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            index = _index(token, *shared.value)
            get = index.ids.get
            for batch in batches:
                texts = batch.column("__text").to_pylist()
                rows, n, size, changes = [], [], [], []
                ids = [np.array([get(w, 0) for w in words(x)], np.int64) for x in texts]
                # which documents have a hit at all, in one search over the batch
                joined = np.concatenate([np.concatenate((x, [0] * PIECE)) for x in ids]) if ids else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(ids)), [len(x) + PIECE for x in ids])
                k = index.keys(joined)
                at = np.minimum(np.searchsorted(index.keys_, k), max(0, len(index.keys_) - 1))
                some = np.unique(owner[: len(k)][index.keys_[at] == k]) if len(index.keys_) else []
                for r in some:
                    for i, w, c in index.leaks(ids[r]):
                        rows.append(r)
                        n.append(i)
                        size.append(w)
                        changes.append(c)
                int32 = lambda x: pa.array(x, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), int32(n), int32(size), int32(changes)], names=schema.names)

        names = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(block)] or [], T.StructType([T.StructField("__n", T.IntegerType()), T.StructField(item, items.schema[item].dataType), T.StructField("field", T.StringType())]))
        found = docs.mapInArrow(run, schema).join(F.broadcast(names), "__n").select(key, item, "field", "words", "changes")  # as many names as a block has
        out = found if out is None else out.unionByName(found)
    return out
