"""Column functions on questions: what time they ask about, how fast their topic ages, which words carry them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.names import fold
from quillmesh.functions.text import let

# What shows the time a question is about, in order; the first that is found holds.
TIMES = {
    "date_range": r"\bbetween\s+\d{4}\b|\bfrom\s+\d{4}\b|\bsince\s+\d{4}\b|\b\d{4}\s*(?:-|–|to)\s*\d{4}\b|\bover the (?:last|past)\b",
    "point_in_time": r"\bas of\b|\bat the (?:time|end) of\b|\bin \d{4}\b",
    "upcoming": r"\bupcoming\b|\bforthcoming\b|\bscheduled\b|\bwill (?:be )?(?:take place|happen|run|host)|\bnext (?:week|month|year|session|summit|conference|event)\b|\bany (?:planned|future)\b|\bplanned\b|\bfuture\b",
    "past": r"\bpast\b|\bprevious(?:ly)?\b|\bformer(?:ly)?\b|\bused to\b|\bhistor(?:y|ical)\b|\bearlier\b|\bonce\b|\bcompleted\b|\bwho\s+(?:was|were)\b|\bwho\s+served\b|\bstepped\s+down\b|\bsucceeded\s+by\b|\bno\s+longer\b",
    "current": r"\bcurrent(?:ly)?\b|\bnow\b|\bat present\b|\bpresently\b|\bongoing\b|\bunderway\b|\bactive\b|\btoday\b|\blatest\b|\bwho\s+(?:is|are)\b|\bwho\s+(?:heads|leads|runs|chairs|directs|manages|oversees)\b",
}
# Topics that go out of date, and signs that the present state is asked for.
VOLATILE = (r"\b(?:apis?|sdks?|endpoints?|changelogs?|release[sd]?|versions?|deprecat\w+|migrations?|upgrade[sd]?|roadmap|documentation|docs|pric(?:e|es|ing)|costs?|tariffs?|fees?|subsid(?:y|ies)|budgets?|"
            r"polic(?:y|ies)|regulations?|regulatory|guidelines?|compliance|mandate[sd]?|amendments?|notifications?|standards?|targets?|deadlines?|laws?|announcements?|announced|launch(?:es|ed)?|press releases?|update[sd]?|statements?|"
            r"latest|newest|most recent|recent(?:ly)?|current(?:ly)?|today|this year|right now|up[- ]to[- ]date|so far|as of)\b")
# Words that carry no topic, written by hand.
STOP = "about after again also been before being between both could does during each from give have having here into list many more most much only other over same should show some such tell than that their them then there these they this those through under until very were what when where which while whom whose will with would your".split()


def _plain(question: Column) -> Column:
    # what has a future of its own is not asked for as one
    return F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"\bfuture\s+of\b", " ")


def temporal_mode(question: Column) -> Column:
    """date_range, point_in_time, upcoming, past, current or none; null and blank questions have none."""
    def chain(q: Column) -> Column:
        out = F.when(F.lit(False), "")
        for mode, pattern in TIMES.items():
            out = out.when(q.rlike(pattern), mode)
        return out.otherwise("none")

    return let(_plain(question), chain)


def is_volatile(question: Column) -> Column:
    """Whether a question is on a topic that goes out of date, or asks for its present state; null questions are not."""
    return F.coalesce(F.lower(question).rlike(VOLATILE), F.lit(False))


def relevance_tolerance(question: Column, tolerance: float = 0.03, widened: float = 2.0) -> Column:
    """How far apart two scores may be to count as equally relevant, wider for volatile topics."""
    return F.when(is_volatile(question), tolerance * widened).otherwise(tolerance)


def content_words(question: Column) -> Column:
    """The different folded words of four letters or more that are no stop words, in order."""
    words = F.split(fold(question), " ")
    return F.coalesce(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOP))), F.array().cast("array<string>"))


def content_terms(question: Column) -> Column:
    """Acronyms as typed, then the content words that are not among them."""
    acronyms = F.coalesce(F.array_distinct(F.regexp_extract_all(question, F.lit(r"\b[A-Z]{2,6}\b"), F.lit(0))), F.array().cast("array<string>"))
    return let(acronyms, lambda a: F.concat(a, F.array_except(content_words(question), F.transform(a, F.lower))))


def key_terms(question: Column) -> Column:
    """Quoted phrases, pairs of capitalised words, codes of letters and digits, acronyms and years, without those that begin another; else the content words."""
    found = lambda p, g=0: F.regexp_extract_all(question, F.lit(p), F.lit(g))
    parts = F.concat(found(r'"([^"]{2,80})"', 1), found(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"), found(r"\b[A-Za-z]+[0-9][A-Za-z0-9]*\b"), found(r"\b[A-Z]{2,6}\b"), found(r"\b(?:19|20)[0-9]{2}\b"))

    def whole(a: Column) -> Column:
        return F.filter(a, lambda x: ~F.exists(a, lambda y: (y != x) & F.startswith(F.lower(y), F.lower(x))))

    return let(F.array_distinct(parts), lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(content_words(question)))


def covered_share(probes: Column, answer: Column) -> Column:
    """The share of probes (array of folded words) that an answer has, null without probes."""
    words = F.split(fold(F.coalesce(answer, F.lit(""))), " ")
    return F.when(F.size(probes) > 0, F.size(F.array_intersect(F.array_distinct(probes), words)) / F.size(F.array_distinct(probes)))


def prefix_score(query: Column, tokens: Column) -> Column:
    """How well a query of one word of three letters or more names a candidate (array of words): equal to or beginning one of them.

    Less the more other words the candidate has; 0 for queries of several words.
    """
    part = F.lit(0.5) + F.lit(0.5) / F.size(tokens)
    one = lambda t: F.when(t == query, part).when(
        F.startswith(t, query) | F.startswith(query, t), part * (0.6 + 0.4 * F.least(F.length(t), F.length(query)) / F.greatest(F.length(t), F.length(query)))).otherwise(0.0)
    fits = (F.length(query) >= 3) & ~query.contains(" ") & (F.size(tokens) > 0)
    return F.when(fits, F.array_max(F.transform(F.filter(tokens, lambda t: t != ""), one))).otherwise(0.0)


def edition_asked(question: Column) -> Column:
    """Which edition of a series a question is about: a stated span or year, latest, earliest, or null."""
    q = F.lower(question)
    year = F.regexp_extract(q, r"\b((?:19|20)\d{2}(?:-\d{2,4})?)\b", 1)
    return F.when(year != "", year).when(q.rlike(r"\b(?:latest|newest|most recent|current)\b"), "latest").when(q.rlike(r"\b(?:first|earliest|oldest)\b"), "earliest")


def theme_scope(question: Column) -> Column:
    """Which group of themes a question is about: main, other or all."""
    q = F.lower(F.coalesce(question, F.lit("")))
    main, other = q.rlike(r"\b(?:main|primary|core|key)\s+themes?\b"), q.rlike(r"\b(?:other|secondary|remaining|additional)\s+themes?\b")
    return F.when(main & ~other, "main").when(other & ~main, "other").otherwise("all")


def relation_asked(question: Column) -> Column:
    """The relationship that a question names first, by its cue, or null."""
    cues = {"funded_by": r"\b(?:fund(?:ed|s|ing|er)|sponsor(?:ed|s)?|donor)", "partner_of": r"\b(?:partner|collaborat)", "led_by": r"\b(?:led by|leads?\b|principal investigator|headed by)", "works_at": r"\b(?:works? (?:at|for)|employed)", "member_of": r"\bmembers? of", "authored": r"\b(?:wrote|written by|authored|author of)"}
    q = F.lower(F.coalesce(question, F.lit("")))
    at = lambda p: F.length(F.regexp_extract(q, rf"(?s)^(.*?)(?:{p})", 1))
    places = F.array(*(F.when(q.rlike(p), F.struct(at(p).alias("at"), F.lit(n).alias("name"))) for n, p in cues.items()))
    return F.array_min(F.filter(places, lambda x: x.isNotNull()))["name"]


# What shows that a question is on the text itself, on tags, and on where a document is, by hand.
ON_TEXT = r"\b(?:mention(?:s|ed|ing)?|say(?:s)?|stat(?:es|ed)|quot(?:e|es|ed)|contain(?:s|ing)?|according to|describ(?:e|es|ed))\b"
ON_TAGS = r"\b(?:tags?|tagged|keywords?|labell?ed)\b"
FOR_DOCUMENT = r"\b(?:find|show|give|share|send|open|download|link to|where (?:is|can))\b.*\b(?:report|document|paper|pdf|brief|file|page|publication)s?\b"
ABOUT_CONTENT = r"\b(?:summari[sz]e|explain|why|how|what does|findings?|conclu(?:de|sion)s?)\b"


def constraints(question: Column) -> Column:
    """Struct of on_text, on_tags and for_document: what a question is put to; a question about content is for no document."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.struct(q.rlike(ON_TEXT).alias("on_text"), q.rlike(ON_TAGS).alias("on_tags"), (q.rlike(FOR_DOCUMENT) & ~q.rlike(ABOUT_CONTENT)).alias("for_document"))


def is_question(text: Column) -> Column:
    """Whether a text asks something: a question mark or a word that asks, and a content word."""
    q = F.lower(F.coalesce(text, F.lit("")))
    return (q.contains("?") | q.rlike(r"^\s*(?:who|what|when|where|why|how|which|is|are|was|were|do|does|did|can|list|show|tell)\b")) & (F.size(content_words(text)) > 0)
