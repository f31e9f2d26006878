"""Splitting texts over a size limit at natural boundaries, with overlap.

Each token of a text becomes a letter that tells what boundary follows it. One pattern with bounded quantifiers takes
that string of letters apart: its alternatives, in order of the strength of the boundary, each consume as much as the
limit allows. SQL array functions turn the parts into pieces that begin with the tokens before them. Nothing leaves
the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.session import small

#: A token is a run of characters other than these.
WS = r" \t\r\n"
#: What may stand at the head of a list line, a table row, a quotation or a heading.
_HEAD = r"^(?:[-*•–+·|>#]|\d{1,3}[.)]|[A-Za-z][.)][ \t])"
_SENTENCE = rf"[.!?।。！？…][\"'”’»)\]]*[{WS}]+$"


def _boundary(token: Column, following: Column) -> Column:
    """What ends with a token and the gap after it: P a paragraph, U a sentence, list line or table row, L a line, t none."""
    return (F.when(following.isNull() | token.rlike(r"\n[ \t\r]*\n"), "P")
            .when(token.rlike(_SENTENCE), "U")
            .when(~token.contains("\n"), "t")
            .when(token.rlike(r"\|[ \t\r]*\n") | following.rlike(_HEAD), "U").otherwise("L"))


def _part(n: Column) -> Column:
    """The pattern of one part of at most n tokens, each a letter by its boundary."""
    def upto(share: int | None, end: str) -> list[Column]:
        least = F.lit(0) if share is None else F.greatest(F.floor(n / share) - 1, F.lit(0))
        return [F.lit(".{"), least.cast("string"), F.lit(","), (n - 1).cast("string"), F.lit("}" + end)]

    out: list[Column] = []
    for share, end in ((2, "P"), (3, "[PU]"), (4, "[PUL]"), (None, "P"), (None, "[PU]"), (None, "[PUL]"), (None, ".")):
        out += [F.lit("|" if out else "(?:"), *upto(share, end)]
    return F.concat(*out, F.lit(")"))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS}]+"))


def split_texts(df: DataFrame, text: str, limit: str, overlap: str) -> DataFrame:
    """One row per piece of every text: ``piece_index`` (from 0), ``pieces`` (their number), ``piece_text``, ``piece_tokens``.

    text, limit and overlap name columns; limit and overlap are numbers of tokens. A text within its limit is one piece,
    unchanged. Otherwise every piece has at most ``limit`` tokens; each but the first begins with the ``overlap`` tokens
    that stand before it (fewer where the limit is not above the overlap: limit - 1). Cuts are at the last end of a
    paragraph in the second half of what fits, else of a sentence, list line or table row, else of a line, else at the
    last of these anywhere, and only where none exists between two tokens. Joined without their overlap the pieces
    give every token of the text in order, with its gaps.

    Null texts, and rows with a null limit, or one below 1, are one piece of the whole text; an empty text is one empty
    piece. Other columns are kept, unless named as the added ones, which replace them. Limits may be of any size.
    """
    added = ("piece_index", "pieces", "piece_text", "piece_tokens")
    own = [c for c in df.columns if c not in added]
    t, n = F.col(text), F.col(limit)
    lap = F.least(F.greatest(F.coalesce(F.col(overlap), F.lit(0)), F.lit(0)), n - 1)
    over = F.coalesce((n >= 1) & (F.length(t) >= 2 * n) & (count_tokens(t) > n), F.lit(False))
    pattern = F.concat(F.lit(r"\A"), _part(n), F.lit(r"|\G(?!\A)"), _part(n - lap))

    def cut(tokens: Column) -> Column:
        letters = F.array_join(F.zip_with(tokens, F.slice(tokens, 2, F.size(tokens)), _boundary), "")
        return _let(F.transform(F.regexp_extract_all(letters, pattern, F.lit(0)), F.length), lambda sizes: _let(
            F.aggregate(sizes, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))))),
            lambda ends: F.zip_with(sizes, ends, lambda size, end: piece(tokens, size, end))))

    def piece(tokens: Column, size: Column, end: Column) -> Column:
        back = F.least(lap, end - size)
        words = F.array_join(F.slice(tokens, end - size - back + 1, size + back), "")
        return F.struct(F.regexp_replace(words, f"[{WS}]+$", "").alias("piece_text"), (size + back).alias("piece_tokens"))

    whole = F.array(F.struct(t.alias("piece_text"), F.coalesce(count_tokens(t), F.lit(0)).alias("piece_tokens")))
    pieces = F.when(over, _let(F.regexp_extract_all(t, F.lit(f"[^{WS}]+[{WS}]*"), F.lit(0)), cut)).otherwise(whole)
    return (df.select(*own, pieces.alias("__pieces")).select(*own, F.size("__pieces").alias("pieces"), F.posexplode("__pieces").alias("piece_index", "__p"))
            .select(*own, "piece_index", "pieces", F.col("__p.piece_text").alias("piece_text"), F.col("__p.piece_tokens").alias("piece_tokens")))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once per row, however often it is used and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def split_characters(text: Column, limit: int, overlap: int) -> Column:
    """Pieces of a text (array of string) where the limit and the overlap are counted in characters.

    The same order of boundaries, with single characters as the last resort. Null gives null, an empty text an empty array.
    """
    def part(n: int) -> str:
        some = lambda least, end: rf"[\s\S]{{{least},{n}}}{end}"
        ends = (r"(?<=\n\n)", r"(?<=[.!?।。！？…])(?=\s)", r"(?<=\n)", r"(?<=\s)")
        return "(?:" + "|".join([some(1, r"\z"), *(some(max(1, n // s), e) for s, e in zip((2, 3, 4, 4), ends)), rf"[\s\S]{{1,{n}}}"]) + ")"

    lap = max(0, min(overlap, limit - 1))
    parts = F.regexp_extract_all(text, F.lit(rf"\A{part(limit)}|\G(?!\A){part(limit - lap)}"), F.lit(0))
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.length(x) + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    return F.zip_with(parts, ends, lambda p, e: F.substring(text, F.greatest(e - F.length(p) - lap, F.lit(0)) + 1, e - F.greatest(e - F.length(p) - lap, F.lit(0))))


def current_rows(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The row with the latest version of each key; of equal versions the greatest by the columns. Null keys are left out."""
    s = F.max(F.struct(F.col(version).alias("__v"), *columns)).alias("__s")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(s).select(key, *(F.col(f"__s.{c}").alias(c) for c in columns))


def split_chunks(chunks: DataFrame, presets: DataFrame) -> DataFrame:
    """Pieces of the current chunks: ``chunk_id, piece_index, pieces, text, token_count, page_range``.

    The limit and overlap are those of the preset named as the bundle, else of ``default``. Before rows move to be
    compared by ``indexed_at``, texts within their limit are left behind, so that only texts to be split are shuffled;
    chunks within their limit have no rows. Pages are those of page_range, put in order where reversed, of which a
    missing end is the other one; else page_number; else null.
    """
    default = lambda c: presets.where("preset = 'default'").agg(F.max(c)).scalar()
    sized = chunks.join(small(presets.select(F.col("preset").alias("bundle"), "child_max_tokens", "child_overlap_tokens")), "bundle", "left")
    sized = sized.select(
        "chunk_id", "indexed_at", "text", "page_number", "page_range",
        F.coalesce("child_max_tokens", default("child_max_tokens")).alias("max_tokens"), F.coalesce("child_overlap_tokens", default("child_overlap_tokens")).alias("overlap"))
    first, last = F.col("page_range.page_start"), F.col("page_range.page_end")
    pages = F.when(first.isNotNull() | last.isNotNull(), F.struct(F.least(first, last).alias("page_start"), F.greatest(first, last).alias("page_end"))).when(
        F.col("page_number").isNotNull(), F.struct(F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end")))
    over = (F.length("text") >= 2 * F.col("max_tokens")) & (count_tokens(F.col("text")) > F.col("max_tokens"))
    sized = sized.select("chunk_id", "indexed_at", F.when(over, F.struct("text", pages.alias("page_range"), "max_tokens", "overlap")).alias("large"))
    large = current_rows(sized, "chunk_id", "indexed_at", ["large"]).where("large is not null").select("chunk_id", "large.*")
    return split_texts(large, "text", "max_tokens", "overlap").select(
        "chunk_id", "piece_index", "pieces", F.col("piece_text").alias("text"), F.col("piece_tokens").alias("token_count"), "page_range")
