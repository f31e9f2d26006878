"""Column functions on passages and answers: page text, numbers, citations, quotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import let

# Ligatures as single characters, and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def repair_ligatures(text: Column) -> Column:
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def is_number_soup(line: Column) -> Column:
    """Whether a line has four words or more, most of them numbers."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    numbers = F.filter(words, lambda w: w.rlike(r"^[-+(]?[\d][\d.,:/%)]*$"))
    return F.coalesce((F.size(words) >= 4) & (F.size(numbers) >= 0.7 * F.size(words)), F.lit(False))


def drop_number_soup(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~is_number_soup(x)), "\n")


def running_key(line: Column) -> Column:
    """The letters of a line in lower case, by which running titles are compared."""
    return F.regexp_replace(F.lower(line), r"[^a-z]+", "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def citation_coverage(answer: Column) -> Column:
    """The share of sentences with a marker [n]; 0 without sentences."""
    s = sentences(answer)
    return F.when(F.size(s) > 0, F.size(F.filter(s, lambda x: x.rlike(r"\[\d+\]"))) / F.size(s)).otherwise(0.0)


def valid_markers(answer: Column, blocks: Column) -> Column:
    """An answer without markers [n] of numbers that no block has."""
    bad = F.array_distinct(F.filter(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: (n.cast("int") < 1) | (n.cast("int") > blocks)))
    return F.aggregate(bad, answer, lambda a, n: F.replace(a, F.concat(F.lit("["), n, F.lit("]")), F.lit("")))


def unknown_numbers(answer: Column, passages: Column) -> Column:
    """Numbers of an answer, without their commas, that none of the passages (array of string) has."""
    plain = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?<![\w.])(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda n: F.regexp_replace(n, ",", ""))
    cited = F.regexp_replace(answer, r"\[\d+\]", "")
    return F.array_except(plain(cited), F.flatten(F.transform(passages, plain)))


def unlinked(answer: Column, known: Column) -> Column:
    """An answer in which links [label](url) of urls not among the known (array of string) are only their labels."""
    urls = F.array_except(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\]\((\S+?)\)"), F.lit(1))), known)
    return F.aggregate(urls, answer, lambda a, u: F.regexp_replace(a, F.concat(F.lit(r"\[([^\]]*)\]\("), F.concat(F.lit(r"\Q"), u, F.lit(r"\E")), F.lit(r"\)")), F.lit("$1")))


def word_runs(text: Column, n: int = 3) -> Column:
    """The different runs of n folded words of a text."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " "), lambda x: x != "")

    def runs(w: Column) -> Column:
        size = F.greatest(F.size(w) - (n - 1), F.lit(0))
        out = F.slice(w, 1, size)
        for i in range(1, n):
            out = F.zip_with(out, F.slice(w, 1 + i, size), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(out)

    return let(F.coalesce(words, F.array().cast("array<string>")), runs)


def grounded(quote: Column, passage: Column, least_words: int = 8, share: float = 0.6) -> Column:
    """Whether a quotation of eight words or more has most of its runs of three words in a passage."""
    words = F.size(F.filter(F.split(F.regexp_replace(F.lower(quote), r"[^a-z0-9]+", " "), " "), lambda x: x != ""))
    q = word_runs(quote)
    return F.coalesce((words >= least_words) & (F.size(F.array_intersect(q, word_runs(passage))) >= share * F.size(q)), F.lit(False))


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether two words are equal or differ by one letter or one exchange of neighbours."""
    near = F.levenshtein(a, b) <= 1
    i = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, 1, i) == F.substring(b, 1, i)))
    at = lambda w, k: F.substring(w, k, F.lit(1))
    swapped = (F.length(a) == F.length(b)) & (at(a, i + 1) == at(b, i + 2)) & (at(a, i + 2) == at(b, i + 1)) & (F.substring(a, i + 3, F.length(a)) == F.substring(b, i + 3, F.length(b))) & (F.length(a) >= i + 2)
    return near | swapped
