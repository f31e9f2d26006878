"""Variant spellings of names: values that name the same person or organisation, linked.

Values are reduced to forms (words, initials). Long forms meet by MinHash banding over the padded q-grams of their
words, with rows and bands from the collision curve at the least similarity that one error leaves. In short forms an
error leaves too little for bands that keep people of one surname apart, and initials and abbreviations leave less;
those meet by exact keys: a word and the other part (equal, of the same formal name, abbreviated, or its initial),
where one word may have lost a letter. However common its words are, no pair is left out. Pairs are verified word by
word by Monge-Elkan similarity. Star clustering gathers the forms around the most frequent ones; forms of initials
join the only cluster that they fit.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import Scratch

# Fixed values, written by hand: forms of address and degrees; words without weight in names of organisations; given names with their short forms.
TITLES = frozenset("dr prof professor mr mrs ms miss mx sir dame madam herr frau mme mlle m señor señora sr sra shri smt phd md msc bsc ma ba jr".split())
LIGHT = frozenset("the for of and on de la le du des der die das für von und et y a an in at".split())
SHORT_FORMS = """
alexander alex sandy sasha xander al lex | alexandra alex sandra sasha lexi | andrew andy drew | anthony tony ant | antonio tony toni | barbara barb babs | beatriz bea betty trixie | benjamin ben benny benji |
catherine cathy kate katie cat kitty | charles charlie chuck chas chaz | charlotte charlie lottie | christina chris tina christy | christopher chris kit topher | cosima cosi | daniel dan danny | david dave davy | deborah deb debbie debby |
dorothy dot dottie dolly | edward ed eddie eddy ned ted teddy | edmund ed eddie ned | ekaterina katya kate katia | eleanor ellie nell nora | elizabeth liz lizzie beth betty bess eliza libby lisa betsy | esperanza espe | farida fari | francis frank fran | francisco paco pancho frank curro kiko |
franz frank | frederick fred freddie rick | friedrich fritz fred fredi | gabriel gabe gabi | geoffrey geoff jeff | gerald gerry jerry | gregory greg | giovanni gianni gio vanni | günther günni | harold harry hal | helen nell nellie | helene lena leni | henry harry hank hal | ignacio nacho iggy | isabella bella izzy |
jacob jake | james jim jimmy jamie | jennifer jen jenny jenn | johannes hannes hans jo johann | john jack johnny jon | jonathan jon jonny | joseph joe joey jo | josé pepe | joshua josh | judith judy | jürgen jogi | katherine kate kathy kat katie kathie kitty kay | kenneth ken kenny | kimberly kim | lakshman laksh |
lawrence larry | leonard leo len lenny | lukasz luke | margaret maggie meg peggy peg marge rita greta madge daisy | martin marty | matthew matt | matthias matze matt matti hias | meenakshi meena | michael mike mick mickey mikey | mohammed mo | nathaniel nate nat | nicholas nick nicky nico klaus | nirmala nimmi | olumide olu |
pamela pam | patricia pat patty tricia trish | patrick pat paddy | peter pete | philip phil | quentin quin | rajeshwari raji | ramón moncho | raymond ray | rebecca becky becca beck | richard rick dick rich ricky richie | robert bob rob bobby robbie bert | ronald ron ronnie | samuel sam sammy | samantha sam | saraswati saras |
stephen steve | steven steve | susan sue susie suzy | theodore ted theo teddy | theresa terry tess | thomas tom tommy | timothy tim | ulrike uli rike ulli | vasanthi vasu | victor vic | victoria vicky tori vic vikki | vincent vince | walter walt wally | wanjiru shiru ciru | william will bill billy willy liam | yashoda yashu | zachary zach zack | zubaida zubi
"""

#: Similarity at which two sets must meet in a band, and how surely, unless ``tune`` is told others.
SIMILARITY, RECALL = 0.5, 0.998
#: Letters of a q-gram, and q-grams from which a form is banded: one error then leaves a similarity of (n - 3) / (n + 3), 0.82 or more.
Q, BANDED = 2, 30
#: Hashes of a signature.
HASHES = 512
#: Monge-Elkan similarity from which two forms name the same.
SAME = 0.85


def collision(s: float, rows: int, bands: int) -> float:
    """The chance that two sets of similarity s share a band."""
    return 1 - (1 - s**rows) ** bands


def tune(s: float = SIMILARITY, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """Rows and bands: the most rows, and so the fewest chance meetings, that reach the recall at s within ``most`` hashes."""
    best = (1, most)
    for rows in range(1, 17):
        for bands in range(1, most // rows + 1):
            if collision(s, rows, bands) >= recall:
                best = (rows, bands)
                break
    return best


def fold(text: str) -> str:
    """Lower case without diacritics; ae, oe and ue, as written for umlauts, as single letters."""
    t = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("đ", "d").replace("æ", "ae"))
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    return re.sub(r"([aou])e", r"\1", t)


_FORMAL: dict[str, set[str]] = {}
for _group in SHORT_FORMS.split("|"):
    _names = [fold(n) for n in _group.split()]
    for _n in _names:
        _FORMAL.setdefault(_n, set()).add(_names[0])
_TITLES = frozenset(map(fold, TITLES))
_LIGHT = frozenset(map(fold, LIGHT))
_token = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?|\d+")


def parse(value: str) -> tuple[list[str], list[str], list[str]]:
    """(words, abbreviated words, initials) of a value; the words without order, the initials in theirs."""
    text = re.sub(r"\(\s*[A-Z.]{2,8}\s*\)", " ", unicodedata.normalize("NFKC", value))
    words, short, initials = [], [], []
    tokens = _token.findall(text)
    known = [t for t in tokens if fold(t.rstrip(".")) not in _TITLES or len(t.rstrip(".")) == 1]
    for t in known or tokens:
        w = fold(t.rstrip(".")).replace("'", "").replace("’", "")
        if len(t.rstrip(".")) == 1:
            initials.append(w)
        elif w in _LIGHT and len(known) > 2:
            continue
        elif t.endswith(".") and len(w) <= 7:
            short.append(w)
        else:
            words.append(w)
    return sorted(words), sorted(short), initials


def edits(a: str, b: str) -> int:
    """0 or 1 for words equal but for one letter or one exchange of neighbours, else 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]:
        return 1
    return 2


def _abbreviates(a: str, b: str) -> bool:
    """Whether a is a beginning of b, or b without some of its letters but for the first, such as mgmt."""
    if len(a) >= len(b) or a[0] != b[0]:
        return False
    rest = iter(b)
    return b.startswith(a) or len(a) >= 3 and all(c in rest for c in a)


def word_similarity(a: str, b: str, a_short: bool = False, b_short: bool = False) -> tuple[float, int]:
    """How alike two words are, and the edits between them."""
    if a == b:
        return 1.0, 0
    if a_short and _abbreviates(a, b) or b_short and _abbreviates(b, a):
        return 0.95, 0
    if _FORMAL.get(a, {a}) & _FORMAL.get(b, {b}):
        return 0.95, 0
    if min(len(a), len(b)) >= 4 and edits(a, b) == 1:
        return 1 - 1 / max(len(a), len(b)), 1
    return 0.0, 2


def compare(a: tuple[list[str], list[str], list[str]], b: tuple[list[str], list[str], list[str]]) -> tuple[float, int]:
    """Monge-Elkan similarity of two forms, the mean of both directions, and the edits; 0 where they can't name the same.

    Every word must have a like word, or its initial, on the other side, at least one a like word of four letters; one
    edit in all is allowed. Initials of both sides must agree in order.
    """
    left = [(w, False) for w in a[0]] + [(w, True) for w in a[1]]
    right = [(w, False) for w in b[0]] + [(w, True) for w in b[1]]
    pairs = sorted(((*word_similarity(x, y, sx, sy), i, j) for (i, (x, sx)), (j, (y, sy)) in itertools.product(enumerate(left), enumerate(right))), key=lambda p: (-p[0], p[1]))
    used_a, used_b, total, changes, strong = {}, set(), 0.0, 0, False
    for s, e, i, j in pairs:
        if s > 0 and i not in used_a and j not in used_b:
            used_a[i] = s
            used_b.add(j)
            total += s
            changes += e
            strong |= min(len(left[i][0]), len(right[j][0])) >= 4
    if not strong or changes > 1:
        return 0.0, 2
    rest_a = [left[i][0] for i in range(len(left)) if i not in used_a]
    rest_b = [right[j][0] for j in range(len(right)) if j not in used_b]
    if rest_a and rest_b:
        return 0.0, 2
    ini_a, ini_b = list(a[2]), list(b[2])
    by_initial = 0
    for rest, own, other in ((rest_a, ini_a, ini_b), (rest_b, ini_b, ini_a)):
        for w in rest:
            # the word stands before its own initials, so its letter is the other's first
            if not other or other[0] not in {n[0] for n in _FORMAL.get(w, {w}) | {w}}:
                return 0.0, 2
            other.pop(0)
            by_initial += 1
    if by_initial == 0 and not used_a:
        return 0.0, 2
    if any(x != y for x, y in zip(ini_a, ini_b)):
        return 0.0, 2
    if len(used_a) + by_initial == 1 and (a[2] or b[2]) and not (a[2] and b[2]):
        return 0.0, 2  # a bare surname against one with an initial
    n = len(used_a) + by_initial
    score = (total + 0.9 * by_initial) / n
    return score, changes


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], []]
        for v in b.column("value").to_pylist():
            w, s, i = parse(v)
            # a value without letters is a form of its own
            cols[0].append("|".join((" ".join(w), " ".join(s), " ".join(i))) if w or s or i else "||" + "\x00" + v)
            for c, x in zip(cols[1:], (w, s, i)):
                c.append(x)
        lists = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([b.column("value"), b.column("n"), pa.array(cols[0], pa.string()), *(pa.array(c, lists) for c in cols[1:])], names=["value", "n", "form", "words", "short", "initials"])


#: A formal name of each group of names that short forms connect.
_GROUP: dict[str, str] = {n: n for n in _FORMAL}
while any(_GROUP[n] != min(_GROUP[f] for f in fs) for n, fs in _FORMAL.items()):
    for _n, _fs in _FORMAL.items():
        _least = min(_GROUP[f] for f in _fs | {_n})
        _GROUP |= {f: _least for f in _fs | {_n}}


def _shortened(w: str) -> set[str]:
    """The word and it without each of its letters: words an edit apart share one. None of words under four letters."""
    return {f"-{w}", *(f"-{w[:i]}{w[i + 1:]}" for i in range(len(w)))} if len(w) >= 4 else set()


def grams(words: list[str]) -> set[tuple[str, int]]:
    """The q-grams of padded words, the second of equal ones apart from the first."""
    count: Counter[str] = Counter()
    out = set()
    for w in words:
        w = f"{' ' * (Q - 1)}{w}{' ' * (Q - 1)}"
        for i in range(len(w) - Q + 1):
            out.add((w[i : i + Q], count[w[i : i + Q]]))
            count[w[i : i + Q]] += 1
    return out


_rng = random.Random(7)
_MULTIPLY, _ADD = (np.array([_rng.getrandbits(64) | 1 for _ in range(HASHES)], np.uint64)[:, None] for _ in range(2))


@functools.lru_cache(None)
def _banding(n: int) -> tuple[int, int]:
    """Rows and bands for sets of n q-grams of which one has an error that the other hasn't."""
    return tune((n - Q - 1) / (n + Q + 1), RECALL, HASHES)


def band_keys(of: set[tuple[str, int]]) -> set[str]:
    """Keys of a set of q-grams; sets whose sizes differ by one at most are banded alike, as an error adds or drops one."""
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(f"{g}{i}") for g, i in of], np.uint64)
    signature = (h[None, :] * _MULTIPLY + _ADD).min(axis=1)
    out = set()
    for n in (len(of), len(of) + 1):
        rows, bands = _banding(n)
        out |= {f"b{n}.{i}:{xxhash.xxh64_hexdigest(signature[i * rows : (i + 1) * rows].tobytes())}" for i in range(bands)}
    return out


def _spellings(words: list[str]) -> list[list[str]]:
    """The words with given names as one of their group, all and all but one, which may have the error."""
    groups = [_GROUP.get(w, w) for w in words]
    return [groups, *([*groups[:i], w, *groups[i + 1 :]] for i, w in enumerate(words) if w != groups[i])]


def pair_keys(form: tuple[list[str], list[str], list[str]], codes: dict[int, set[str]], initials: dict[int, int]) -> set[tuple[str, int]]:
    """(key, side) of a form. Two forms that ``compare`` accepts share a key of side 0, or one of side 1 and one of side 2.

    Surely so but for banded forms, which share one as surely as RECALL says.

    codes: the first letters of abbreviated words by the number of words of their forms; initials: the most initials
    that forms of so many words have.
    """
    parts = sorted([(w, False) for w in form[0]] + [(w, True) for w in form[1]], key=lambda p: -len(p[0]))
    k, ini, out, every = len(parts), form[2], set(), set().union(*codes.values())
    sets = [grams(w) for w in _spellings(form[0])] if k >= 2 and not form[1] else []
    for g in sets:
        out |= {(x, 0) for x in band_keys(g)} if len(g) >= BANDED else set()
    banded = bool(sets) and min(map(len, sets)) > BANDED  # one with an error has as many but one, and is banded as well
    letters = lambda w: {n[:1] for n in _FORMAL.get(w, {w}) | {w}}
    equal = lambda p: {f"={f}" for f in _FORMAL.get(p[0], {p[0]})}
    abbreviates = lambda p, mark: {mark + p[0][:2]} if p[1] else set()
    abbreviated = lambda p, mark, known: {mark + c for c in {p[0][:1], *(p[0][:1] + x for x in p[0][1:])} & known}
    # x: a word of side 1 abbreviates one of side 2, y: the reverse
    short = lambda p, side, known: abbreviates(p, "xy"[side - 1]) | abbreviated(p, "yx"[side - 1], known)
    cross = lambda a, b: {"|".join(sorted(c)) for c in itertools.product(a, b)}

    def two(p, q, side: int) -> set[str]:
        """Keys of two words, at most one with an edit."""
        x, y = (equal(p) | short(p, side, every), equal(q) | short(q, side, every))
        return cross(x, y | _shortened(q[0])) | cross(x | _shortened(p[0]), y)

    if k == 1:
        # the other has one word as well, and the same first initial or none
        head = f"1{ini[0] if ini else ''}:"
        out |= {(head + x, 0) for x in equal(parts[0]) | _shortened(parts[0][0])}
        out |= {(head + x, 1) for x in abbreviates(parts[0], "x")} | {(head + x, 2) for x in abbreviated(parts[0], "x", every)}
    elif k == 2 and not banded:
        p, q = parts
        out |= {("2:" + x, 0) for x in cross(equal(p), equal(q) | _shortened(q[0])) | cross(_shortened(p[0]), equal(q))}
    elif k > 2 and not banded:
        # all words but one are equal or short forms
        groups = [_GROUP.get(w, w) for w, _ in parts]
        out |= {(f"{k}:" + " ".join(sorted(groups[:i] + groups[i + 1:])), 0) for i in range(k)}
    if k >= 2:
        known, some = codes.get(k, set()), next((i for i, p in enumerate(parts) if not p[1]), None)
        for i, p in enumerate(parts):
            if p[1]:
                # the longest other word that is not abbreviated, if any
                q = parts[some if some is not None else 0 if i else 1]
                out |= {(f"{k}a:{x}|{y}", 1) for x in abbreviates(p, "x") for y in equal(q) | short(q, 1, every) | _shortened(q[0])}
            for x in abbreviated(p, "x", known):
                out |= {(f"{k}a:{x}|{y}", 2) for j, q in enumerate(parts) if j != i for y in equal(q) | short(q, 2, every) | _shortened(q[0])}
    # words of side 2 stand as initials in side 1
    if ini and k == 1:
        out |= {(f"i{ini[0]}:{x}", 1) for x in equal(parts[0]) | short(parts[0], 1, every) | _shortened(parts[0][0])}
    elif ini and k >= 2:
        out |= {(f"j{ini[0]}:{x}", 1) for p, q in itertools.combinations(parts, 2) for x in two(p, q, 1)}
    if k >= 2 and k - 1 <= initials.get(1, 0):
        # of one word more than there are initials, one is no initial
        for i, p in enumerate(parts[: initials[1] + 1]):
            heads = set().union(*(letters(w) for j, (w, _) in enumerate(parts) if j != i))
            out |= {(f"i{h}:{x}", 2) for h in heads for x in equal(p) | short(p, 2, every) | _shortened(p[0])}
    most = max((m for n, m in initials.items() if 2 <= n < k <= n + m), default=0)
    if most:
        for (i, p), (j, q) in itertools.combinations(enumerate(parts[: most + 2]), 2):
            heads = set().union(*(letters(w) for n, (w, _) in enumerate(parts) if n not in (i, j)))
            out |= {(f"j{h}:{x}", 2) for h in heads for x in two(p, q, 2)}
    return out


def _keys(codes: dict[int, set[str]], initials: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        make = lambda c: pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int8())], names=["form", "key", "side"])
        cols: tuple[list, list, list] = ([], [], [])
        for b in batches:
            for form, w, s, i in zip(*(b.column(c).to_pylist() for c in ("form", "words", "short", "initials"))):
                for key, side in pair_keys((w, s, i), codes, initials):
                    for c, x in zip(cols, (form, xxhash.xxh64_intdigest(key) - 2**63, side)):
                        c.append(x)
                if len(cols[0]) >= 50_000:
                    yield make(cols)
                    cols = ([], [], [])
        yield make(cols)

    return run


def _candidates(forms: DataFrame, keep: Scratch) -> DataFrame:
    """(a, b) with a < b: all pairs of forms that share a key. forms: form, words, short, initials."""
    k = F.size("words") + F.size("short")
    codes: dict[int, set[str]] = {}
    for r in forms.select(k.alias("k"), F.explode("short").alias("s")).select("k", F.substring("s", 1, 2).alias("c")).distinct().toLocalIterator():
        codes.setdefault(r.k, set()).add(r.c)
    initials = {r.k: r.m for r in forms.where(F.size("initials") > 0).groupBy(k.alias("k")).agg(F.max(F.size("initials")).alias("m")).toLocalIterator()}
    keyed = keep.write(forms.select("form", "words", "short", "initials").mapInArrow(_keys(codes, initials), "form string, key long, side byte"))
    side = lambda n, name: keyed.where(F.col("side") == n).select("key", F.col("form").alias(name))
    both = side(0, "a").join(side(0, "b"), "key").where("a < b").select("a", "b")
    across = side(1, "x").join(side(2, "y"), "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return both.unionByName(across).distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    side = lambda f: tuple(x.split() for x in f.split("|", 2))
    for b in batches:
        a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
        got = [compare(side(x), side(y)) for x, y in zip(a, c)]
        ok = [i for i, (s, _) in enumerate(got) if s >= SAME]
        take = pa.array(ok, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("a").take(take), b.column("b").take(take), pa.array([got[i][0] for i in ok], pa.float64()), pa.array([got[i][1] for i in ok], pa.int32())], names=["a", "b", "similarity", "edits"])


def _stars(nodes: DataFrame, edges: DataFrame, keep: Scratch) -> DataFrame:
    """Star clustering: (form, center, edits). nodes: form, n; edges: a, b, similarity, edits, both directions.

    A form that no unassigned neighbour outweighs, by rows, then degree, then its text, is a center; the neighbours of
    centers join the most similar one. That is repeated among the rest, until none is left.
    """
    degree = edges.groupBy(F.col("a").alias("form")).agg(F.count("*").alias("degree"))
    left = keep.write(nodes.join(degree, "form", "left").select("form", F.struct("n", F.coalesce("degree", F.lit(0)).alias("degree"), "form").alias("weight")))
    weight = lambda side: left.select(F.col("form").alias(side), F.col("weight").alias(f"w{side}"))
    links, out = keep.write(edges.join(weight("a"), "a").join(weight("b"), "b").select("a", "b", "similarity", "wa", "wb")), None
    while left.limit(1).count():
        beaten = links.where("wb > wa").select(F.col("a").alias("form")).distinct()
        centers = keep.write(left.join(beaten, "form", "left_anti").select("form"))
        joined = links.join(centers.select(F.col("form").alias("b")), "b").groupBy(F.col("a").alias("form")).agg(F.max_by("b", F.struct("similarity", "wb")).alias("center"))
        assigned = keep.write(centers.select("form", F.col("form").alias("center")).unionByName(joined))
        out = assigned if out is None else out.unionByName(assigned)
        before = (left, links, centers)
        left = keep.write(left.join(assigned.select("form"), "form", "left_anti"))
        links = keep.write(links.join(left.select(F.col("form").alias("a")), "a", "left_semi").join(left.select(F.col("form").alias("b")), "b", "left_semi"))
        for t in before:
            keep.drop(t)
    return out if out is not None else nodes.select("form", F.col("form").alias("center")).limit(0)


def link_names(df: DataFrame, name: str = "author") -> DataFrame:
    """The different values of a column of names with their ``cluster``: ``value, cluster, rows``, one row per value.

    Values of one cluster name the same person or organisation. Names may differ in case, spacing, diacritics, titles,
    the order of their parts, initials for given names and left-out middle initials, short forms, abbreviations, and by
    one typing error in each value. A surname alone, or with another given name, is no link. A value of initials and
    surname joins the one person that fits it; where several fit, or none, it stays with values of the same initials.

    Null values are left out; blank ones and ones without letters are clusters of their own. An empty table gives an
    empty result. Other columns are ignored; repeated rows only add to ``rows``.
    """
    keep = Scratch(df.sparkSession, "names")
    values = df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n"))
    lists = "array<string>"
    parsed = keep.write(values.mapInArrow(_forms, f"value string, n long, form string, words {lists}, short {lists}, initials {lists}"))
    forms = keep.write(parsed.groupBy("form").agg(F.sum("n").alias("n"), *(F.any_value(c).alias(c) for c in ("words", "short", "initials"))))
    # pairs of all parts of the key space on all cores, however few bytes they are
    spread = 2 * df.sparkSession.sparkContext.defaultParallelism
    edges = keep.write(_candidates(forms, keep).repartition(spread, "a", "b").mapInArrow(_verify, "a string, b string, similarity double, edits int"))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", "edits"))
    # a form of initials has one word, and no given name
    brief = forms.where((F.size("words") + F.size("short") <= 1) & (F.size("initials") > 0)).select("form")
    whole = forms.join(brief, "form", "left_anti").select("form", "n")
    both = edges.join(brief.select(F.col("form").alias("a")), "a", "left_anti").join(brief.select(F.col("form").alias("b")), "b", "left_anti")
    stars = keep.write(_stars(whole, both, keep))
    fits = edges.join(brief.select(F.col("form").alias("a")), "a").join(stars.select(F.col("form").alias("b"), "center"), "b").groupBy("a", "center").agg(F.min("edits").alias("edits"))
    fits = fits.groupBy("a").agg(F.min("edits").alias("least"), F.collect_set(F.struct("edits", "center")).alias("all"))
    fits = fits.select(F.col("a").alias("form"), F.transform(F.filter("all", lambda x: x.edits == F.col("least")), lambda x: x.center).alias("centers"))
    placed = keep.write(fits.where(F.size("centers") == 1).select("form", F.col("centers")[0].alias("center")))
    alone = forms.join(brief, "form").join(placed, "form", "left_anti").select("form", "n")
    among = edges.where("edits = 0").join(alone.select(F.col("form").alias("a")), "a").join(alone.select(F.col("form").alias("b")), "b")
    rest = keep.write(_stars(alone, among, keep))
    centers = stars.unionByName(placed).unionByName(rest)
    return keep.write(parsed.join(centers, "form").select("value", F.col("center").alias("cluster"), F.col("n").alias("rows")))


def name_pairs(linked: DataFrame) -> DataFrame:
    """Pairs of different values of one cluster, by code point: ``author_a < author_b``."""
    a, b = linked.select("cluster", F.col("value").alias("author_a")), linked.select("cluster", F.col("value").alias("author_b"))
    return a.join(b, "cluster").where("author_a < author_b").select("author_a", "author_b")
