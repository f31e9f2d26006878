"""Encoding whole corpora with a public byte-level tokenizer, and decoding.

The vocabulary file is a parameter and is read by each Python worker. A byte-level tokenizer cuts a text by a fixed
pattern and encodes every cut by itself, so the different cuts of an Arrow batch are encoded once each by the
``tokenizers`` library and kept for later batches, up to a bound.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabularies are, if the caller gives no path.
VOCABULARIES = os.environ.get("QUILLMESH_VOCABULARIES", "/opt/tokenizers")
#: Different cuts that a worker remembers; beyond that it starts afresh.
REMEMBERED = 300_000
#: Fixed value: the pattern by which byte-level tokenizers of this kind cut a text.
CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    return f"{VOCABULARIES}/{name}"


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """One tokenizer in a Python worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cut = regex.compile(CUTS).findall
        self.ids: dict[str, list[int]] = {}
        self.spans: dict[str, list[tuple[int, int]]] = {}

    def learn(self, cuts: set[str]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.spans.clear()
        new = [c for c in cuts if c not in self.ids]
        for c, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
            self.ids[c] = e.ids
            self.spans[c] = e.offsets

    def encode(self, texts: list[str | None]) -> tuple[list[list[str]], pa.Array]:
        """The cuts of each text, and the ids as an Arrow list array."""
        cuts = [self.cut(t) if t else [] for t in texts]
        self.learn(set(itertools.chain.from_iterable(cuts)))
        ids = self.ids
        rows = [list(itertools.chain.from_iterable([ids[c] for c in row])) for row in cuts]
        return cuts, _lists(rows)

    def offsets(self, cuts: list[list[str]]) -> tuple[pa.Array, pa.Array]:
        """Code point positions at which each token starts and ends; tokens that share a character share its span."""
        starts, ends = [], []
        for row in cuts:
            a, b, at = [], [], 0
            for c in row:
                for s, e in self.spans[c]:
                    a.append(at + s)
                    b.append(at + e)
                at += len(c)
            starts.append(a)
            ends.append(b)
        return _lists(starts), _lists(ends)


def _lists(rows: list[list[int]]) -> pa.Array:
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.fromiter(itertools.chain.from_iterable(rows), np.int32, at[-1])))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def _byte_strings(path: str) -> list[bytes]:
    vocab = encoder(path).tokenizer.get_vocab(with_added_tokens=True)
    table = byte_table()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        # a special token is no string of byte characters
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def _with(df: DataFrame, added: list[T.StructField]) -> tuple[T.StructType, list[str]]:
    names = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name not in names]
    return T.StructType(kept + added), [f.name for f in kept]


def encode(df: DataFrame, text: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int): the text encoded without special tokens; with ``offsets`` also ``starts`` and ``ends``.

    A null or empty text has empty lists. Strings of special tokens in a text are ordinary text. starts and ends are
    code point positions in the text; a character that is split among tokens gives each of them its whole span. Other
    columns are kept; ones named as the added columns are replaced. Every row is encoded whole, whatever its length.
    """
    path = path or vocabulary()
    ints = T.ArrayType(T.IntegerType(), False)
    schema, kept = _with(df, [T.StructField(n, ints, False) for n in (["ids", "starts", "ends"] if offsets else ["ids"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            cuts, ids = e.encode(b.column("__text").to_pylist())
            cols = [b.column(c) for c in kept] + [ids]
            if offsets:
                cols += e.offsets(cuts)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.select(*kept, df[text].cast("string").alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``decoded`` (string): the text of the ids. Null ids give null, an empty list the empty text.

    The bytes of all ids are joined before they are read as UTF-8, so a character split among tokens comes back whole;
    ids cut out of the middle of a text may begin or end inside a character, which then is U+FFFD. Unknown ids raise.
    """
    path = path or vocabulary()
    schema, kept = _with(df, [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_strings(path)
        for b in batches:
            out = [None if r is None else b"".join([table[i] for i in r]).decode("utf-8", "replace") for r in b.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.string())], names=schema.names)

    return df.select(*kept, df[ids].alias("__ids")).mapInArrow(run, schema)
