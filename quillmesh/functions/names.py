"""Column functions that fold names, titles and addresses for comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with diacritics and the letters they are compared as.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžłø"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyszlo"


def fold(text: Column) -> Column:
    """Lower case, without diacritics, punctuation as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def person(text: Column) -> Column:
    """A folded name without leading titles and trailing suffixes, as long as two words remain."""
    t = F.regexp_replace(fold(text), r"^(?:(?:dr|prof|professor|mr|mrs|ms|miss|sir) )+([a-z]+ )", "$1")
    return F.regexp_replace(t, r"^([a-z]+ [a-z].*?)(?: (?:jr|sr|phd|md|ii|iii))+$", "$1")


def initials(folded: Column) -> Column:
    """The first letters of the words of a folded name."""
    return F.array_join(F.transform(F.filter(F.split(folded, " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def sound(word: Column) -> Column:
    """A rough key of how a word sounds: ee as i, ck as k, ph as f, no h after consonants, no double letters."""
    w = F.lower(word)
    for a, b in (("ee", "i"), ("oo", "u"), ("ck", "k"), ("ph", "f"), (r"([bcdgkpt])h", "$1")):
        w = F.regexp_replace(w, a, b)
    for c in "abcdefgiklmnoprstuz":
        w = F.regexp_replace(w, c + c + "+", c)
    return w


def url_key(url: Column) -> Column:
    """An address for comparison: host without www, path in lower case, without scheme, query, fragment and final slash."""
    u = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://", ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(u, r"^www\.", ""), r"/+$", "")


def content_words(text: Column) -> Column:
    """The different folded words of four letters or more."""
    return F.array_distinct(F.filter(F.split(fold(text), " "), lambda w: F.length(w) >= 4))


# Short legal forms and what they are written out as, by hand.
FORMS = {"ltd": "limited", "pvt": "private", "inc": "incorporated", "corp": "corporation", "co": "company", "govt": "government", "univ": "university", "inst": "institute", "dept": "department", "assn": "association", "ctr": "centre", "center": "centre"}
# Words without weight in a name.
MINOR = ("of", "for", "and", "the", "in", "on", "de", "la")


def organisation(text: Column) -> Column:
    """A name as an organisation's: lower case, & as and, short legal forms written out."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")), " "), lambda w: w != "")
    full = F.create_map(*(F.lit(x) for pair in FORMS.items() for x in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(full, w), w)), " ")


def unjoined(text: Column) -> Column:
    """The names of a value that joins them by commas without a blank after them."""
    return F.filter(F.transform(F.split(text, r",(?=\S)"), F.trim), lambda x: x != "")


def significant_initials(folded: Column) -> Column:
    """The first letters of a folded name's words, without minor ones."""
    return F.array_join(F.transform(F.filter(F.split(folded, " "), lambda w: (w != "") & ~w.isin(*MINOR)), lambda w: F.substring(w, 1, 1)), "")


def acronym_fits(acronym: Column, initials: Column) -> Column:
    """Whether one begins the other, or the acronym's letters stand among the initials in order. Both in lower case."""
    return F.startswith(initials, acronym) | F.startswith(acronym, initials) | F.regexp_like(initials, F.array_join(F.split(acronym, ""), ".*"))
