"""Statistics of a document's text that tell prose from lists, tables and junk.

A text is taken apart into blocks, and counts of each block's lines (columns, markers, repeats) tell how it is laid
out. The blocks of one layout are compared together with structural profiles by the Jensen-Shannon divergence of three
distributions: layout, function words (of the nearest language) and character classes. Each belongs to the kind of the
nearest profile, and the document to the kind of most of its characters. Profiles begin from the prose of each
language and are fitted to a bounded sample of labelled documents where there is one.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, written by hand: function words of each language with their usual number in a thousand words of prose.
FUNCTION_WORDS = {
    "en": "the 70 of 30 and 26 to 22 a 20 in 22 is 11 was 11 that 10 for 8 it 8 with 7 as 7 by 8 on 6 be 6 had 7 from 6 have 6 which 5 are 5 not 5 this 5 at 5 or 4 were 4 has 4 been 4 but 4 they 4 their 3 its 3 will 3 what 3 when 3 we 3 an 3 if 2 there 2 than 2 how 2 who 2 some 2 so 2 more 2 one 2 can 2 about 2 most 1 other 1 our 1 into 1 once 1 each 1 every 1 neither 1 nor 1 although 1 us 1 you 4 i 4 he 4 she 3 his 3 her 3",
    "fr": "le 40 la 30 de 50 des 20 les 25 du 14 un 18 une 14 et 22 est 12 en 14 a 12 à 16 au 8 aux 4 dans 10 par 8 pour 9 que 10 qui 9 il 8 on 4 pas 7 ne 6 ont 5 ce 6 cette 4 sur 6 plus 5 avec 4 été 5 se 6 son 4 sa 3 leur 3 mais 3 ou 3 donc 2 puis 2 entre 2 comme 2 elle 3 sont 3 reste 1 encore 2 mieux 1 malgré 1 pendant 1 selon 1 pourquoi 1 comment 1 c'est 3 n'est 2 y 2",
    "de": "der 34 die 34 und 28 in 18 den 14 das 12 von 12 zu 10 mit 9 ist 10 im 8 nicht 8 ein 8 eine 8 des 8 dem 7 auf 7 für 7 es 5 sich 6 auch 5 wird 5 werden 5 wurde 5 hat 5 haben 4 als 5 an 5 nach 4 bei 4 um 4 aus 4 wie 4 noch 3 nur 3 dass 4 aber 2 oder 2 zwischen 2 trotz 2 allem 1 deshalb 1 außerdem 1 obwohl 1 rund 1 ihren 1 worden 2 konnte 1 einmal 1 er 3 sie 5 wir 3",
    "es": "el 34 la 30 de 50 los 18 las 12 que 24 y 22 en 20 un 12 una 10 no 12 se 12 por 11 con 8 del 10 al 6 es 8 su 7 para 8 a 14 ha 6 fue 7 lo 5 como 5 más 5 si 3 sus 3 o 3 ya 3 pero 2 entre 3 sido 2 aunque 2 todavía 1 según 1 eso 1 esta 2 este 2 unas 1 tan 1 qué 2 cómo 2 pesar 1",
    "hi": "के 40 में 36 की 30 है 30 का 20 से 24 को 18 और 16 ने 12 पर 14 कि 12 भी 9 नहीं 9 इस 12 यह 8 हैं 8 था 5 एक 6 जो 4 तो 4 ही 4 गया 7 हुआ 6 कहा 4 बारे 4 दौरान 4 बिना 3 फिर 4 पहले 4 लिए 5 तक 3 साथ 3 थी 3 या 3 हो 4 कर 4",
}
# Fixed values, written by hand: function words of more languages, in order of how often they stand in prose; their shares follow Zipf's rule.
RANKED_WORDS = {
    "it": "di e il la che a in un per è del non con una i le della si da sono al come più nel dei ma anche gli alla lo ha o se questo",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já",
    "nl": "de van het een en in is dat op te zijn voor met die niet aan er om als ook dan bij maar uit door naar hij wordt nog of worden zich",
    "pl": "w i na z się nie do że jest to o po jak za od a przez co dla ale są tym oraz ich jego przy tylko lub być który ze",
    "sv": "och i att det som en på är av för med den till inte har de om ett han var jag men sig från vi så kan man när år hade",
    "da": "og i at det er en den til på af for med der de ikke har som et han fra var om kan men sig vi blev også efter år skal",
    "tr": "ve bir bu da de için ile olarak çok daha olan gibi kadar sonra ne en ise ama her o var olduğu ancak göre iki",
    "id": "yang dan di dari untuk dengan pada ini itu dalam tidak akan adalah ke oleh juga sebagai telah dapat atau mereka ada lebih bahwa karena",
    "ro": "de și în a la cu care că pe un o este nu din se pentru mai au sunt fi fost al prin sau dar după ca lui",
    "cs": "a se v na je že o s z do i to k ve pro za by ale si po jako podle od jsou které který tak nebo jeho až",
    "fi": "ja on ei että se oli hän joka mutta ovat kuin niin myös sen jos ole kun mukaan vain jo vuonna hänen tai",
    "hu": "a az és hogy nem is egy ez de volt van meg már csak ha mint azt el vagy még ami amely után lehet között szerint bár minden ki be",
    "sw": "ya wa na kwa ni katika la za cha hii kuwa pia kama lakini hiyo huo wote ili yao baada yake hicho kwamba ingawa mji watu",
    "vi": "và của là có các được trong cho một không với những này để người đã khi từ cũng về ra như đến tại nhiều",
}
# The share of each class of characters in prose, in a thousand. In order: letters and their marks, blanks, digits, marks of punctuation, other symbols.
CHARACTERS = {"latin": (815, 150, 12, 20, 3), "devanagari": (790, 175, 12, 20, 3), "spaced": (810, 150, 12, 25, 3), "unspaced": (880, 15, 15, 87, 3)}

#: Words that running text needs before its function words are judged.
JUDGED_WORDS = 12
#: Labelled documents that profiles are fitted to, at most; and how many of them the profiles to begin with count as.
LABELS, PRIOR = 1_000, 20
#: A kind has a document if more than this share of its characters is of it.
MOST = 0.5

_TRIM = re.escape(".,;:!?।()«»\"“”„'’‘¿¡[]{}*_…|")
#: Words with single marks inside, such as c'est or 1.5; marks at their ends don't belong to them.
_WORD = re.compile(rf"[^\s{_TRIM}]+(?:[{_TRIM}][^\s{_TRIM}]+)*").findall

KINDS = ("prose", "list", "table", "junk")
_PROFILES = {lang: {w: int(n) / 1000 for w, n in zip(s.split()[::2], s.split()[1::2])} for lang, s in FUNCTION_WORDS.items()}
_PROFILES |= {lang: {w: 0.1 / (r + 2) for r, w in enumerate(s.split())} for lang, s in RANKED_WORDS.items()}
_JUDGED_FIRST = frozenset(FUNCTION_WORDS)
#: The function words of a language by thirds of frequency, so that short texts can be judged, and how often those are usual.
_PARTS = {lang: (r[:5], r[5:15], r[15:]) for lang, p in _PROFILES.items() for r in [sorted(p, key=p.get, reverse=True)]}
_USUAL = {lang: [sum(_PROFILES[lang][w] for w in part) for part in parts] for lang, parts in _PARTS.items()}
#: The languages of each function word.
_LANGUAGES = {w: [k for k, p in _PROFILES.items() if w in p] for w in {w for p in _PROFILES.values() for w in p}}
_ALL_FUNCTION = frozenset(w for lang in FUNCTION_WORDS for w in _PROFILES[lang])
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_MARKER = re.compile(r"\s*(?:[-*•–—·▪▫◦‣⁃●○■□]\s+|\(?\d{1,3}[.)\]:]\s+|\(?[A-Za-z][.)]\s+|\(?[ivxIVX]{1,4}[.)]\s+)\S")
_LEADER = re.compile(r"(?:\.{4,}|(?:\. ){3,}|…{2,}|_{4,})\s*\d*\s*$")
_KEYED = re.compile(r"\s*[^\s:=–—-][^:=–—]{0,40}?\s?(?::|=|\s[–—-])\s+\S")
_REFERENCE = re.compile(r"[^()]{3,80}\((?:19|20)\d\d[a-z]?\)|^\s*\[\d+\]\s")
_NUMBERED_PAGES = re.compile(r"\d+\s*\(\d+\)\s*[:,]\s*\d+|\bpp?\.\s*\d+|\bdoi\b")
_SENTENCE_END = re.compile(r"[.!?।。！？…][\"'”’»)\]]*\s*$")
_CELL = re.compile(r"\s*(?:[-–—*.]|n/?a\.?|N/?A\.?|null|[<>~≈±+-]?\s?[\d][\d.,:/ '%]*\s?[%°€$£A-Za-z]{0,4}\d?|)\s*$")
_SPLITS = (re.compile(r"\|"), re.compile(r"\t"), re.compile(r";"), re.compile(r","), re.compile(r" {2,}|\u3000+"))
_SEPARATOR = re.compile(r"\s*([-=_*~#.+–—])(?:\s?\1){2,}\s*$")
_INNER_END = re.compile(r"\w[.!?।] +[\w¿¡\"«„]")
_SEPARATORS = ("|", "\t", ";", ",", "  ")
_RULE = re.compile(r"^[\s|:+=-]*$")


def jensen_shannon(p: list[float], q: list[float]) -> float:
    """The divergence of two distributions, from 0 (equal) to 1 (nothing in common)."""
    out = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        if a > 0:
            out += a * math.log2(a / m) / 2
        if b > 0:
            out += b * math.log2(b / m) / 2
    return out


_PUNCTUATION = frozenset(".,;:!?'\"()-–—’‘“”«»¿¡।॥…。，、！？：；「」『』（）،؛؟・")


@functools.cache
def _is_mark(ch: str) -> bool:
    """Whether a character is a vowel sign or the like of a script that writes with them; not one put on top of Latin letters."""
    return ch > "\u0590" and unicodedata.category(ch) in ("Mn", "Mc")


_beyond_ascii = re.compile(r"[^\x00-\x7f]+").findall


def _characters(text: str) -> dict[str, int]:
    """How often each character stands in a text; ASCII by its bytes, in one pass of numpy."""
    ascii_ = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)[:128]
    out = {chr(i): int(ascii_[i]) for i in np.flatnonzero(ascii_)}
    if not text.isascii():
        out |= Counter("".join(_beyond_ascii(text)))
    return out


def _character_classes(text: str, count: dict[str, int] | None = None) -> list[float]:
    """Shares of letters and their marks, blanks, digits, punctuation and other symbols."""
    count = _characters(text) if count is None else count
    c = [0, 0, 0, 0, 0]
    for ch, n in count.items():
        if ch.isalpha() or _is_mark(ch):
            c[0] += n
        elif ch.isspace():
            c[1] += n
        elif ch.isdigit():
            c[2] += n
        elif ch in _PUNCTUATION:
            c[3] += n
        else:
            c[4] += n
    total = max(1, len(text))
    return [x / total for x in c]


#: How blocks are laid out: in columns, as entries, as running text, or as the same again and again.
LAYOUTS = ("cells", "entries", "running", "repeats")


class Profile(NamedTuple):
    """A structural profile: three distributions. Words are shares of three parts of the function words and of the rest."""

    kind: str
    layout: list[float]
    words: list[float] | None
    chars: list[float]


@functools.cache
def _only(layout: str) -> list[float]:
    return [float(x == layout) for x in LAYOUTS]


_NO_GRAMMAR = [0.0, 0.0, 0.0, 1.0]
_LETTERS = [c / 1000 for c in CHARACTERS["latin"]]
#: Profiles to begin with besides those of prose, by name.
PRIORS = {
    "list": Profile("list", _only("entries"), [0.03, 0.03, 0.03, 0.91], [0.75, 0.14, 0.04, 0.05, 0.02]),
    "table": Profile("table", _only("cells"), _NO_GRAMMAR, [0.45, 0.2, 0.2, 0.08, 0.07]),
    "junk words": Profile("junk", _only("running"), _NO_GRAMMAR, _LETTERS),
    "junk symbols": Profile("junk", _only("running"), _NO_GRAMMAR, [0.4, 0.1, 0.2, 0.1, 0.2]),
    "junk marks": Profile("junk", _only("running"), _NO_GRAMMAR, [0.1, 0.2, 0.1, 0.2, 0.4]),
    "junk repeats": Profile("junk", _only("repeats"), None, _LETTERS),
}


class Part(NamedTuple):
    """The blocks of one layout of a text. words is None where they can't be judged."""

    layout: str
    size: int
    lang: str
    words: list[float] | None
    chars: list[float]


def _part(layout: str, size: int, words: list[str], text: str) -> Part:
    counts = Counter(words)
    n = max(1, len(words))
    shares = dict.fromkeys(_PROFILES, 0)
    for w in counts.keys() & _LANGUAGES.keys():
        for k in _LANGUAGES[w]:
            shares[k] += counts[w]
    lang, second = sorted(shares, key=lambda k: (shares[k], k in _JUDGED_FIRST, k == "en"), reverse=True)[:2]
    characters = _characters(text)
    chars = _character_classes(text, characters)
    # of a script that no language here is written in, words can't be judged
    letters, known = 0, 0
    for c, k in characters.items():
        if c.isalpha():
            letters += k
            known += k if _known(c) else 0
    if 2 * (letters - known) > letters:
        return Part(layout, size, "unspaced" if chars[1] < 0.08 else "spaced", None, chars)
    # a text may be of two languages
    own = [sum(counts[w] for w in part) / n + sum(counts[w] for w in other if w in counts and w not in _PROFILES[lang]) / n for part, other in zip(_PARTS[lang], _PARTS[second])]
    return Part(layout, size, lang, [*own, 1 - sum(own)] if len(words) >= JUDGED_WORDS else None, chars)


def _known(c: str) -> bool:
    """Whether a letter is Latin or Devanagari."""
    return c < "\u0250" or "\u0900" <= c <= "\u097f" or "\u1e00" <= c <= "\u1eff"


@functools.cache
def _prose(lang: str) -> Profile:
    usual = _USUAL.get(lang)
    chars = CHARACTERS[lang if lang in CHARACTERS else "devanagari" if lang == "hi" else "latin"]
    return Profile("prose", _only("running"), [*usual, 1 - sum(usual)] if usual else None, [c / 1000 for c in chars])


def divergences(part: Part, profile: Profile) -> tuple[float, float, float]:
    """Divergences of layout, words and characters. Words that can't be judged count as those of prose."""
    usual = _USUAL.get(part.lang) or _USUAL["en"]
    own = part.words or [*usual, 1 - sum(usual)]
    words = 0.0
    if profile.words:
        if profile.kind == "prose" and own[3] < profile.words[3]:  # more of them is no sign against prose
            words = jensen_shannon([1 - own[3], own[3]], [1 - profile.words[3], profile.words[3]]) / 4
        else:
            words = jensen_shannon(own, profile.words)
    return jensen_shannon(_only(part.layout), profile.layout), words, jensen_shannon(part.chars, profile.chars)


def nearest(part: Part, profiles: dict[str, Profile]) -> tuple[str, float, float]:
    """The kind of the nearest profile, and the divergences of words and characters from the language's prose."""
    prose = profiles.get(f"prose {part.lang}") or _prose(part.lang)
    own = divergences(part, prose)
    best, kind = sum(own), "prose"
    only = _only(part.layout)
    for p in profiles.values():
        # the divergence of the layout alone tells most profiles to be farther
        if p.kind != "prose" and jensen_shannon(only, p.layout) <= best and (d := sum(divergences(part, p))) < best:
            best, kind = d, p.kind
    return kind, own[1], own[2]


def largest_part(text: str | None) -> Part | None:
    return max(parts_of(text), key=lambda p: p.size, default=None) if text else None


def fit_profiles(labelled: Iterable[tuple[Part | None, str]], prior: int = PRIOR) -> dict[str, Profile]:
    """Profiles fitted to (largest part, kind) of labelled documents: means of the parts nearest to each profile of their kind.

    The profiles to begin with count as ``prior`` documents, so that few labels change them little.
    """
    near: dict[str, list[Part]] = defaultdict(list)
    for part, kind in labelled:
        if part is None:
            continue
        if kind == "prose":
            near[f"prose {part.lang}"].append(part)
        elif own := {n: p for n, p in PRIORS.items() if p.kind == kind}:
            near[min(own, key=lambda n: sum(divergences(part, own[n])))].append(part)
    out = dict(PRIORS)
    for name, parts in near.items():
        begin = PRIORS.get(name) or _prose(name.split(" ", 1)[1])

        def mean(first: list[float], rest: list[list[float]]) -> list[float]:
            return [(prior * x + math.fsum(r[i] for r in rest)) / (prior + len(rest)) for i, x in enumerate(first)]

        words = [p.words for p in parts if p.words]
        out[name] = Profile(begin.kind, mean(begin.layout, [_only(p.layout) for p in parts]), mean(begin.words, words) if begin.words and words else begin.words, mean(begin.chars, [p.chars for p in parts]))
    return out


def fitted_profiles(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "kind", most: int = LABELS) -> dict[str, Profile]:
    """``fit_profiles`` for at most ``most`` of the labels, chosen by a hash of their keys, whatever the number of documents.

    labels: key, kind. Labels with a null key or kind, of no document or of a blank text are left out; of several for a
    key the least by code point holds. Without labels the profiles to begin with come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, largest_part(t)) for t, k in zip(b.column("__text").to_pylist(), b.column("__kind").to_pylist())]
            cols = [[k, p.layout, p.size, p.lang, p.words, p.chars] for k, p in rows if p]
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cols], t) for i, t in enumerate(types)], names=["kind", *Part._fields])

    chosen = labels.where(F.col(key).isNotNull() & F.col(kind).isNotNull()).groupBy(key).agg(F.min(kind).alias("__kind")).orderBy(F.xxhash64(key), key).limit(most)
    parts = df.where(F.col(text) != "").select(key, F.col(text).alias("__text")).join(F.broadcast(chosen), key)  # at most ``most`` rows
    rows = parts.select("__text", "__kind").mapInArrow(run, "kind string, layout string, size long, lang string, words array<double>, chars array<double>").collect()
    return fit_profiles((Part(*r[1:]), r.kind) for r in sorted(rows, key=lambda r: (r.kind, r.layout, r.size, r.chars)))


def _is_table(lines: list[str]) -> bool:
    n = len(lines)
    if n < 2:
        return False
    block = "\n".join(lines)
    for k, split in enumerate(_SPLITS):
        if block.count(_SEPARATORS[k]) < (1.4 if k in (2, 3) else 0.7) * 0.7 * n:  # too few for most rows to be cut
            continue
        rows = [x for x in lines if not _RULE.match(x)] if k in (0, 4) else lines
        cells = [[c for c in split.split(x.strip().strip("|") if k == 0 else x.rstrip("\n"))] for x in rows]
        if len(cells) < 2:
            continue
        many = Counter(len(c) for c in cells)
        cols, often = many.most_common(1)[0]
        least = 2 if k in (0, 1) else 3
        if k == 4:  # blanks as columns: empty cells vanish
            fit = sum(v for c, v in many.items() if c >= 2)
            cols = max(many)
        elif k in (2, 3):  # separators of thousands may stand in cells
            fit = sum(v for c, v in many.items() if c >= least)
        else:
            fit = often
        if cols < least or fit < 0.7 * len(cells):
            continue
        body = [c for row in cells for c in row[1:]]
        filled = [c for c in body if c.strip()]
        if len(filled) < 0.5 * len(body):
            continue
        numeric = sum(1 for c in filled if _CELL.match(c)) / max(1, len(filled))
        short = sum(1 for c in body if len(c.split()) <= 6) / max(1, len(body))
        if numeric >= 0.4 and short >= 0.8 or k in (0, 1) and short >= 0.9 and len(cells) >= 3 and _wordy(body):
            return True
    return False


def _wordy(cells: list[str]) -> bool:
    """Whether cells are made of words or numbers, not of stray marks."""
    text = "".join(cells)
    good = sum(1 for c in text if c.isalnum() or c == " ")
    return good >= 0.85 * max(1, len(text)) and sum(len(c.strip()) > 1 for c in cells) > 0.5 * len(cells)


def _function_share(words: list[str]) -> float:
    return sum(map(_ALL_FUNCTION.__contains__, words)) / max(1, len(words))


def _plain_words(text: str) -> list[str]:
    return _WORD(text.lower())


def _is_list(lines: list[str]) -> bool:
    n = len(lines)
    if n < 2 or len({x.strip() for x in lines}) < max(2, 0.35 * n):
        return False
    if _function_share(_plain_words("\n".join(lines))) >= 0.25:  # running sentences
        return False

    def share(pattern: re.Pattern, search: bool = False) -> float:
        return sum(1 for x in lines if (pattern.search(x) if search else pattern.match(x))) / n

    if share(_LEADER, True) >= 0.6 or share(_REFERENCE) >= 0.6 and share(_NUMBERED_PAGES, True) >= 0.4:
        return True
    words = [_plain_words(x) for x in lines]
    sizes = sorted(len(w) for w in words)
    common = _function_share([w for ws in words for w in ws])
    bare = [x[m.end() - 1 :] if (m := _MARKER.match(x)) else x for x in lines]
    chars = _character_classes("\n".join(bare))
    if chars[0] < 0.6 or chars[4] > 0.05:
        return False
    if share(_MARKER) >= 0.6 and (common < 0.2 or sizes[n // 2] <= 6):
        return True
    if share(_KEYED) >= 0.7 and common < 0.22 and sizes[n // 2] <= 14:
        return True
    ends = share(_SENTENCE_END, True)
    # entries without a mark: short lines that aren't parts of sentences
    return n >= 3 and sizes[n // 2] <= 10 and common < 0.12 and ends < 0.3 and share(_INNER_END, True) < 0.1 and sizes[n // 2] >= 1 and chars[2] < 0.2


def _repeats(words: list[str], lines: list[str]) -> bool:
    """Whether the same words or lines come again and again."""
    if len(lines) >= 5 and len({x.strip() for x in lines}) < 0.34 * len(lines):
        return True
    n = len(words)
    if n < 12 or len(set(words)) > 0.4 * n:
        return False
    if len(set(words)) <= 3:
        return True
    runs = [tuple(words[i : i + 6]) for i in range(n - 5)]
    return len(set(runs)) < 0.3 * len(runs)


def _blocks(text: str) -> list[list[str]]:
    blocks: list[list[str]] = [[]]
    for x in _LINES.split(text):
        if x.strip():
            if not _SEPARATOR.match(x):  # lines that only part others belong to no kind
                blocks[-1].append(x)
        elif blocks[-1]:
            blocks.append([])
    blocks = [b for b in blocks if b]
    if len(blocks) >= 3 and all(len(b) <= 2 for b in blocks):  # entries parted by blank lines
        whole = [x for b in blocks for x in b]
        if _is_table(whole) or _is_list(whole):
            return [whole]
    return blocks


def parts_of(text: str, words: list[str] | None = None, blocks: list[list[str]] | None = None) -> list[Part]:
    """The parts of a text by layout; none of a blank one."""
    blocks = _blocks(text) if blocks is None else blocks
    words = _plain_words(text) if words is None else words
    laid: dict[str, list[str]] = defaultdict(list)
    repeated = _repeats(words, [x for b in blocks for x in b])
    for b in blocks:
        table = _is_table(b)
        laid["repeats" if repeated and not table else "cells" if table else "entries" if _is_list(b) else "running"] += b
    out = []
    for layout, lines in laid.items():
        joined = "\n".join(lines)
        # lines that only part others hold no words of the text
        whole = len(laid) == 1 and len(lines) == sum(1 for x in _LINES.split(text) if x.strip())
        own = words if whole else _plain_words(joined)
        part = _part(layout, sum(len(x.strip()) for x in lines), own, joined)
        longest = max(map(len, own), default=0)
        if layout == "running" and part.lang != "unspaced" and longest > 60 and longest > 0.3 * len(joined):  # unbroken letters
            part = part._replace(layout="repeats")
        out.append(part)
    return out


def statistics(text: str | None, profiles: dict[str, Profile] | None = None) -> dict | None:
    """The statistics of one text, by which its kind is told; None for a null or blank one."""
    if not text or not text.strip():
        return None
    blocks, words = _blocks(text), _plain_words(text)
    full = [x for b in blocks for x in b]
    size = dict.fromkeys(KINDS, 0)
    lang, d_words, d_chars = "", 0.0, 0.0
    for part in sorted(parts_of(text, words, blocks), key=lambda p: (p.layout == "running", p.size)):
        kind, d_words, d_chars = nearest(part, profiles or PRIORS)  # of the running text, or else of the largest part
        lang = part.lang
        size[kind] += part.size
    total = max(1, sum(size.values()))
    kind = max(KINDS, key=lambda k: size[k])
    if size[kind] <= MOST * total:
        kind = "prose" if size["prose"] else kind
    letters = sum(map(len, words))
    symbols = sum(n for c, n in _characters(text).items() if not (c.isalnum() or c.isspace() or _is_mark(c)))
    return {
        "words": len(words), "mean_word_length": letters / max(1, len(words)), "symbol_ratio": symbols / len(text),
        "punctuated_lines": sum(1 for x in full if _SENTENCE_END.search(x)) / max(1, len(full)), "common_words": _function_share(words),
        "nearest_language": lang, "word_divergence": d_words, "character_divergence": d_chars,
        "list_share": size["list"] / total, "table_share": size["table"] / total, "junk_share": size["junk"] / total, "kind": kind,
    }


_COLUMNS = {
    "words": T.IntegerType(), "mean_word_length": T.DoubleType(), "symbol_ratio": T.DoubleType(), "punctuated_lines": T.DoubleType(), "common_words": T.DoubleType(),
    "nearest_language": T.StringType(), "word_divergence": T.DoubleType(), "character_divergence": T.DoubleType(),
    "list_share": T.DoubleType(), "table_share": T.DoubleType(), "junk_share": T.DoubleType(), "kind": T.StringType(),
}


def text_statistics(df: DataFrame, text: str = "text", profiles: dict[str, Profile] | None = None) -> DataFrame:
    """Adds the statistics of ``statistics`` as columns, and ``kind`` (prose, list, table or junk), that of the nearest of the profiles.

    profiles: of ``fitted_profiles``, or else those to begin with.

    Null, empty and blank texts have null in all of them. Whole texts are read; rows are independent, so repeated ones
    have equal statistics. Other columns are kept, unless named as the added ones, which replace them.
    """
    kept = [f for f in df.schema.fields if f.name not in _COLUMNS]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in _COLUMNS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), *[pa.float64()] * 4, pa.string(), *[pa.float64()] * 5, pa.string()]
        for b in batches:
            rows = [statistics(t, profiles) or {} for t in b.column("__text").to_pylist()]
            added = [pa.array([r.get(c) for r in rows], t) for c, t in zip(_COLUMNS, types)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *added], names=schema.names)

    return df.select(*names, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
