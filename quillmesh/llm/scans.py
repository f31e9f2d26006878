"""Repair of text from scanned pages: page furniture, divided words, misread characters.

Running titles and page numbers are found by fuzzy repetition of lines at page edges and by the sequence of numbers.
The words of all pages make a vocabulary; words divided at a line's end or in a cell are joined, and characters set
right, where the vocabulary knows the outcome far better than what stands there. Only words are shuffled and joined
for that, never whole pages.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import Scratch, small

# Fixed values, written by hand: what is read, and what may stand there, in letters.
LETTERS = {
    "c": ["e"], "@": ["a"], "f": ["t"], "5": ["s"], "$": ["s"], "j": ["i"], "0": ["o"], "ri": ["n"], "1": ["l", "i"], "cl": ["d"], "ii": ["u"], "rn": ["m"], "b": ["h", "ti", "6"], "9": ["g"], "vv": ["w"], "u": ["ll"],
    "|": ["l", "i"], "!": ["l", "i"], "8": ["b"], "6": ["b"], "4": ["a"], "7": ["t"], "2": ["z"], "q": ["g"], "nn": ["m"], "lc": ["k"], "h": ["b"], "t": ["f"], "e": ["c"], "i": ["l"], "l": ["i", "t"], "o": ["c"], "v": ["y"], "d": ["cl"], "m": ["rn"], "li": ["h"], "tt": ["u"],
}
# The same in numbers.
DIGITS = {"o": "0", "q": "0", "d": "0", "i": "1", "l": "1", "|": "1", "!": "1", "z": "2", "s": "5", "$": "5", "b": "8", "g": "9"}

#: How many times more often than what is read a word must stand elsewhere, to be what was meant.
RATIO = 8
#: The same for words that stand in pages without a sign of a scan as well.
FAR_RATIO = 250
#: Of so many times that a misread word stands in running text, at most one is in a text without furniture and divided words.
CLEAN = 4
#: A word that stands so few times may be misread wherever it stands: FEW, or one in FEW_OF of all words where that is more.
FEW, FEW_OF = 3, 300_000
#: How alike two lines must be to be the same title.
ALIKE = 0.88
#: Lines at page edges, before and after one, that it is compared with.
NEARBY = 12

MARKS = "-‐­¬"
_MARKS = frozenset(MARKS)
_PAGE = re.compile(r"^\W*(?:(?:page|seite|p[aá]g(?:ina|\.)?|p\.)\s*)?([0-9OoIlSsBZzb]{1,4}|[ivxlc]{1,6})(?:\s*(?:of|von|de|sur|/)\s*[0-9OoIlSsBZzb]{1,4})?[^\w.,;:!?]*$", re.I)
_ROMAN = re.compile(r"^\W*(?:x{0,3}(?:ix|iv|v?i{0,3})|x?l?x{0,3}v?i{0,3})\W*$")
_STYLED = re.compile(r"^\s*(?:[-–—\[(]\s*\w+\s*[-–—\])]|(?:page|seite|p[aá]g)\w*\.?\s.*)\s*$", re.I)
_TITLED = (re.compile(r"^\s*(?P<n>[0-9OoIlSsBZ]{1,4})(?:\s{2,}|\t|\s*\|\s*)(?P<t>\S.*?)\s*$"), re.compile(r"^\s*(?P<t>\S.*?)(?:\s{2,}|\t|\s*\|\s*)(?P<n>[0-9OoIlSsBZ]{1,4})\s*$"))
_READ_AS_DIGITS = frozenset("0123456789OoIlSsBZ")
_ENDED = re.compile(r"[.!?।…:;][\"'”’»)\]]*\s*$")
_DIVIDED = re.compile(rf"([^\W_][\w@$'’-]*)([{MARKS}])[ \t]*$")
_BROKEN = re.compile(rf"([^\W_][\w@$'’-]*)([{MARKS}])[ \t]*<br\s*/?>[ \t]*([^\W_][\w@$'’]*)", re.I)
_FIRST = re.compile(r"\s*([^\W_][\w@$'’-]*)")
_ONLY_LETTERS = re.compile(r"[OoIlSsBZzg]{1,2}")
_CELL_LETTERS = re.compile(r"(\|\s*)([OoIlSsBZzg]{1,2})(?=\s*\|)")
_TOKEN = re.compile(r"[^\s|<>/]+")
_EDGE = ".,;:!?()[]{}\"'“”„«»‘’…*_–—" + MARKS


def _has_digit(s: str) -> bool:
    return any(c.isdigit() for c in s)


def _title(s: str) -> str:
    return re.sub(r"\W+", " ", s).strip().casefold()


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 0.25 * max(len(a), len(b)):
        return False
    first, second = a.split(), b.split()
    if len(first) > 2 and len(second) > 2 and not set(first) & set(second):
        return False  # not every word of a title is misread
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE


def page_furniture(lines: list[str], hints: list[str]) -> set[int]:
    """Indexes of lines of running text that are running titles, page numbers, or both. hints: titles known for the text."""
    body = [i for i, x in enumerate(lines) if x.strip()]
    if len(body) < 2:
        return set()
    width = max(len(lines[i].rstrip()) for i in body)
    place = {i: k for k, i in enumerate(body)}
    numbers: dict[int, int | None] = {}
    titles: list[tuple[int, str]] = []
    titled: set[int] = set()
    for i in body:
        x = lines[i].strip()
        if (m := _PAGE.match(x)) and (_has_digit(x) or _ROMAN.match(x)):
            n = "".join(DIGITS.get(c.lower(), c) for c in m[1])
            numbers[i] = int(n) if _has_digit(x) and n.isdigit() else None
        else:
            for p in _TITLED if x[:1] in _READ_AS_DIGITS or x[-1:] in _READ_AS_DIGITS else ():
                if (m := p.match(x)) and _has_digit(m["n"]) and any(c.isalpha() for c in m["t"]) and not _ENDED.search(m["t"]):
                    titled.add(i)
                    titles.append((i, _title(m["t"])))
                    break
    bare = [i for i in numbers if not _STYLED.match(lines[i])]
    # numbers without a mark are page numbers if they go up from page to page, or where one stands alone between lines
    for i in bare:
        others = [n for j, n in numbers.items() if j != i and n is not None]
        n = numbers[i]
        if others and n is not None and not any(0 < abs(n - o) <= 12 for o in others):
            del numbers[i]
    known = [t for t in {_title(h) for h in hints if h} if len(t) > 3]
    if not numbers and not titled:  # the beginning of a text, before any page number: a title over the first lines
        first = lines[body[0]].strip()
        below = lines[body[1]].lstrip()
        plain = len(first) <= 120 and not _ENDED.search(first) and not first.endswith(",") and len(first.split()) >= 2 and any(c.isalpha() for c in first)
        short = len(first) < 0.75 * width and below[:1].isupper() and first[:1].isupper()
        return {body[0]} if plain and (any(_alike(_title(first), h) for h in known) or first.isupper() or short) else set()
    near = {j for i in numbers for j in (_step(body, place, i, -1), _step(body, place, i, 1)) if j is not None} | {body[0], body[-1]}
    near -= set(numbers) | titled
    seen = {i: _title(lines[i]) for i in body if i not in numbers and i not in titled}
    found: set[int] = set()

    def could_be(i: int) -> bool:
        x = lines[i].strip()
        return len(x) <= 120 and not (x.endswith(".") or x.endswith(",")) and any(c.isalpha() for c in x) and len(x.split()) <= 14

    edge = [i for i in sorted(near) if could_be(i)]
    for k, i in enumerate(edge):
        t = seen[i]
        at = bisect.bisect(titles, (i, ""))
        # titles recur on the pages next to theirs, so nearby lines tell, however long the text is
        if any(_alike(t, h) or len(t) > 8 and h.startswith(t) for h in known) or any(_alike(t, o) for _, o in titles[max(0, at - NEARBY) : at + NEARBY]):
            found.add(i)
        elif any(_alike(t, seen[j]) for j in edge[max(0, k - NEARBY) : k] + edge[k + 1 : k + 1 + NEARBY]):
            found.add(i)
    for i, t in seen.items():  # away from page numbers only lines that are a known title, as a whole
        if i not in found and could_be(i) and any(_alike(t, h) for h in known):
            found.add(i)
    sides = _sides(body, place, numbers, found)
    for i in sorted(near - found):
        # titles seen once: such as titles of even pages in a short text
        if not could_be(i):
            continue
        x = lines[i].strip()
        above, below = _flow(body, place, i, -1, numbers, titled | found, lines), _flow(body, place, i, 1, numbers, titled | found, lines)
        side = -1 if _step(body, place, i, 1) in numbers else 1
        score = 2 * (x.isupper() and len(x) > 6) + (len(x) < 0.75 * width) + (side in sides)
        starts_upper = x[:1].isupper() or not x[:1].isalpha() or x[:1].lower() == x[:1].upper()
        score += bool(above is not None and not _ENDED.search(above) and starts_upper)
        score += bool(below is not None and not _ENDED.search(x) and (below.lstrip()[:1].isupper() or above is not None and not _ENDED.search(above)))
        score += all(w[:1].isupper() for w in x.split() if len(w) > 3)
        if starts_upper and score >= 3 and (_step(body, place, i, 1) in numbers or _step(body, place, i, -1) in numbers or x.isupper()):
            found.add(i)
    return set(numbers) | titled | found


def _step(body: list[int], place: dict[int, int], i: int, by: int) -> int | None:
    k = place[i] + by
    return body[k] if 0 <= k < len(body) else None


def _sides(body: list[int], place: dict[int, int], numbers: dict, found: set[int]) -> set[int]:
    """On which sides of page numbers titles were found."""
    return {s for i in numbers for s in (-1, 1) if _step(body, place, i, s) in found}


def _flow(body: list[int], place: dict[int, int], i: int, by: int, numbers: dict, furniture: set[int], lines: list[str]) -> str | None:
    """The nearest line of running text before or after."""
    j = _step(body, place, i, by)
    while j is not None and (j in numbers or j in furniture):
        j = _step(body, place, j, by)
    return lines[j] if j is not None else None


def table_furniture(lines: list[str]) -> set[int]:
    """Indexes of rows that are page numbers or repeat the header row."""
    out: set[int] = set()
    head = next((i for i, x in enumerate(lines) if "|" in x), None)
    if head is None:
        return out
    header = _title(lines[head])
    for i in range(head + 1, len(lines)):
        cells = [c.strip() for c in lines[i].strip().strip("|").split("|")]
        filled = [c for c in cells if c]
        if len(filled) == 1 and len(cells) <= max(1, lines[head].count("|") - 1) and _PAGE.match(filled[0]) and _has_digit(filled[0]):
            out.add(i)
        elif i > head + 1 and len(header) > 2 and not re.match(r"^[\s|:-]*$", lines[i]) and _alike(_title(lines[i]), header):
            out.add(i)
    return out


def _divided(line: str) -> re.Match | None:
    """The word that is divided at the end of a line, if one is."""
    return _DIVIDED.search(line, max(0, line.rfind(" ", 0, len(line.rstrip(" \t"))))) if line.rstrip(" \t")[-1:] in _MARKS else None


def words_of(line: str) -> list[str]:
    """The words and numbers of a line, lower case, without marks around them."""
    return [w for t in _TOKEN.findall(line.lower()) if (w := t if t.isalpha() else t.strip(_EDGE))]


@functools.lru_cache(4)
def _furniture(text: str, hints: tuple[str, ...]) -> set[int]:
    """page_furniture of a text; a text often follows its own beginning, which needed the same."""
    return page_furniture(text.split("\n"), list(hints))


def _cells(row: str) -> list[str]:
    return row.strip().strip("|").split("|")


def _numeric_columns(rows: list[str]) -> set[int]:
    """Columns of which most cells have a digit; rule rows don't count."""
    cells = [_cells(r) for r in rows if not re.match(r"^[\s|:-]*$", r)]
    return {j for j in range(max(map(len, cells), default=0)) if 2 * sum(1 for c in cells if j < len(c) and _has_digit(c[j])) > len(cells)}


def _analyse(field: str, text: str, hints: list[str], context: str | None = None) -> tuple[list[int], list[tuple[int, str]], list[tuple[int, int, str, str, str]]]:
    """Furniture lines, (line, word) of whole words, and (line, line of the rest, first part, mark, rest) of divided ones; lines from 1."""
    lines = text.split("\n")
    table = field == "markdown"
    if table:
        out = table_furniture(lines)
    elif context and len(context) > len(text) and context.startswith(text):  # the beginning of a longer text, which shows more
        out = {i for i in _furniture(context, tuple(hints)) if i < len(lines)}
    else:
        out = _furniture(text, tuple(hints))
    tokens: list[tuple[int, str]] = []
    broken: list[tuple[int, int, str, str, str]] = []
    skip = ""
    keep = [i for i in range(len(lines)) if i not in out and lines[i].strip()]
    numeric = _numeric_columns([lines[i] for i in keep[1:]]) if table else set()
    for k, i in enumerate(keep):
        line = lines[i]
        if table:
            for m in _BROKEN.finditer(line):
                broken.append((i + 1, i + 1, m[1].lower(), m[2], m[3].lower()))
            line = re.sub(r"<br\s*/?>", " ", _BROKEN.sub(" ", line))
            if k > 0:  # below the header, letters read for a number's only digits, in columns of numbers
                tokens += [(i + 1, "#" + c.strip().lower()) for j, c in enumerate(_cells(line)) if j in numeric and _ONLY_LETTERS.fullmatch(c.strip())]
        else:
            if skip and (m := _FIRST.match(line)):
                line = line[m.end() :]
            skip = ""
            if m := _divided(line):
                after = keep[k + 1] if k + 1 < len(keep) else None
                rest = _FIRST.match(lines[after]) if after is not None else None
                if rest or after is None:
                    skip = "rest" if rest else ""
                    broken.append((i + 1, (after if after is not None else i) + 1, m[1].lower(), m[2], rest[1].lower() if rest else ""))
                    line = line[: m.start()]
        tokens += [(i + 1, w) for w in words_of(line)]
    whole = bool(context) and context.startswith(text) and context[len(text) : len(text) + 1].strip() == ""
    if not table and not whole and tokens and keep and lines[keep[-1]].rstrip()[-1:].isalnum():
        tokens.pop()  # a text that was cut may end within a word
    return [i + 1 for i in sorted(out)], tokens, broken


def _number_like(w: str) -> bool:
    """Whether a word is a number with letters among its digits, or (after #) for all of them."""
    if w.startswith("#"):
        return True
    if w.isascii() and any(c.isalpha() or c in "|$!" for c in w) and 2 * sum(c.isdigit() for c in w) >= sum(c not in ".,%" for c in w):
        return bool(re.fullmatch(r"[-+]?\d[\d.,]*%?", "".join(DIGITS.get(c, c) for c in w)))
    return False


def _numbers_like(w: pd.Series) -> pd.Series:
    return w.map(_number_like)


def corrections(w: str, twice: bool = False) -> dict[str, int]:
    """Words that may have been read as w, each with the place of the first change."""
    out: dict[str, int] = {}
    for i in range(len(w)):
        for n in (1, 2):
            for true in LETTERS.get(w[i : i + n], ()) if i + n <= len(w) else ():
                out.setdefault(w[:i] + true + w[i + n :], i)
    if twice and len(w) >= 5:
        for c, i in list(out.items()):
            for d, j in corrections(c).items():
                out.setdefault(d, min(i, j))
    out.pop(w, None)
    return out


_PARSED = "record_id string, field string, digest string, counted boolean, furniture array<int>, tokens array<struct<line:int,word:string>>, broken array<struct<line:int,rest_line:int,a:string,mark:string,b:string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    brk = pa.list_(pa.struct([("line", pa.int32()), ("rest_line", pa.int32()), ("a", pa.string()), ("mark", pa.string()), ("b", pa.string())]))
    for b in batches:
        furniture, broken, counted, sizes = [], [], [], [0]
        at: list[int] = []
        said: list[str] = []
        for field, text, hints, context in zip(*(b.column(c).to_pylist() for c in ("field", "text", "hints", "context"))):
            f, t, d = _analyse(field, text, [h for h in hints or [] if h], context)
            furniture.append(f)
            counted.append(not (field == "head_text" and context))  # each text once, and no beginnings of others
            at += [i for i, _ in t]
            said += [w for _, w in t]
            sizes.append(len(at))
            broken.append([dict(zip(("line", "rest_line", "a", "mark", "b"), x)) for x in d])
        tokens = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(said, pa.string())], ["line", "word"]))
        yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("field"), b.column("digest"), pa.array(counted, pa.bool_()), pa.array(furniture, pa.list_(pa.int32())), tokens, pa.array(broken, brk)],
                                         names=["record_id", "field", "digest", "counted", "furniture", "tokens", "broken"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            # of words of two letters, those that mix digits and letters
            if len(w) < 2 or len(w) == 2 and not (any(c.isdigit() for c in w) and any(c.isalpha() for c in w)) or len(w) > 60 or not any(c.isalpha() for c in w) and "@" not in w:
                continue
            once = corrections(w)
            for c, i in corrections(w, twice=True).items():
                for col, x in zip(cols, (w, n, c, i, 1 if c in once else 2)):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["word", "n", "meant", "place", "changes"])


class Repair:
    """What is wrong in scanned records, as frames that share the corpus vocabulary.

    records: ``record_id, field, text``, ``hints`` (array of titles) and optionally ``context`` (a text that begins with
    this one, whose furniture tells more). Null and blank texts have nothing wrong; equal rows come out once. Field
    ``markdown`` is read as a table, others as running text. Texts are told apart by their digests, so that words are
    counted and joined without them; ``repaired`` alone moves each text, once. Without ``texts`` there are no digests,
    and ``repaired`` is not to be had.
    """

    def __init__(self, records: DataFrame, texts: bool = True):
        keep = self.keep = Scratch(records.sparkSession, "scans")
        if "context" not in records.columns:
            records = records.withColumn("context", F.lit(None).cast("string"))
        self.rows = records.where("trim(text) <> ''").withColumn("digest", F.md5(F.col("text").cast("binary")) if texts else F.lit(None).cast("string"))
        # equal rows are told apart nowhere: results are distinct, and shares of counts stay the same
        self.parsed = keep.write(self.rows.select("record_id", "field", "text", "digest", "hints", "context").mapInArrow(_parse, _PARSED))
        self.words = keep.write(self.parsed.where("counted").select(
            (F.col("field") != "markdown").cast("int").alias("running"),
            ((F.col("field") != "markdown") & (F.size("furniture") == 0) & (F.size("broken") == 0)).cast("int").alias("clean"),  # no sign of a scan
            F.explode("tokens.word").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("running").alias("n_running"), F.sum("clean").alias("n_clean")))
        self.divided = self._divided()
        self.misread = self._misread(self.words)

    def _meant(self, words: DataFrame, ratio: int = RATIO) -> DataFrame:
        """word, meant, place: words that are misread. words: word, n."""
        c = words.mapInArrow(_candidates, "word string, n long, meant string, place int, changes int")
        c = c.join(self.words.select(F.col("word").alias("meant"), F.col("n").alias("often")), "meant").where(F.col("often") >= ratio * F.greatest(F.col("n"), F.lit(1)) * F.col("changes"))
        return c.groupBy("word").agg(F.max_by(F.struct("meant", "place"), F.struct(-F.col("changes"), "often", "meant")).alias("m")).select("word", "m.meant", "m.place")

    def _misread(self, words: DataFrame) -> DataFrame:
        number = F.pandas_udf(_numbers_like, "boolean")
        by_digits = words.where(F.col("word").rlike(r"[0-9]") & F.col("word").rlike(r"[a-z|$!]") | F.col("word").startswith("#"))
        numbers = by_digits.where(number("word")).select("word")
        back = F.translate("word", "".join(DIGITS) + "#", "".join(DIGITS.values()))
        read = numbers.select("word", back.alias("meant"), F.lit(0).alias("place"))
        # words proper stand in pages without a sign of a scan as well, misread ones hardly
        mixed = F.col("word").rlike(r"[0-9@$|!]") & F.col("word").rlike(r"[a-z]")
        few = max(FEW, (words.agg(F.sum("n")).first()[0] or 0) // FEW_OF)
        suspect = words.where((F.col("n_clean") * CLEAN <= F.col("n_running")) | (F.col("n") <= few) | mixed)
        found = self._meant(suspect.join(numbers, "word", "left_anti").select("word", "n")).unionByName(read)
        # whatever the pages, a word so much rarer than what it may have been
        other = words.where(~mixed & ~((F.col("n_clean") * CLEAN <= F.col("n_running")) | (F.col("n") <= few)))
        return self.keep.write(found.unionByName(self._meant(other.select("word", "n"), FAR_RATIO)))

    def _divided(self) -> DataFrame:
        """a, mark, b of divided words, with the word meant and the part that is misread (a, b or null); words that keep their mark are left out."""
        pairs = self.parsed.select(F.explode("broken").alias("x")).select("x.a", "x.mark", "x.b").distinct()
        forms = pairs.select("a", "mark", "b", F.explode(F.array(
            F.struct(F.concat("a", "b").alias("word"), F.lit(False).alias("with_mark")), F.struct(F.concat_ws("-", "a", "b").alias("word"), F.lit(True).alias("with_mark")))).alias("f")).select("a", "mark", "b", "f.*")
        forms = self.keep.write(forms.join(self.words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))))
        # forms that no line has may be misread as well
        unseen = forms.groupBy("a", "mark", "b").agg(F.max("n").alias("best")).where("best = 0").join(forms, ["a", "mark", "b"])
        meant = self.keep.write(self._meant(unseen.select("word", F.lit(0).cast("long").alias("n")).distinct()))
        forms = forms.join(meant, "word", "left").join(self.words.select(F.col("word").alias("meant"), F.col("n").alias("often")), "meant", "left")
        best = forms.groupBy("a", "mark", "b").agg(
            *(F.max(F.when(F.col("with_mark") == w, F.greatest("n", F.coalesce("often", F.lit(0))))).alias(f"n_{w}") for w in (True, False)),
            F.max_by(F.struct("word", "meant", "place", "with_mark"), F.struct(F.greatest("n", F.coalesce("often", F.lit(0))), ~F.col("with_mark"))).alias("m"))
        belongs = F.col("mark").isin("-", "‐") & ((F.col("b") != "") & (F.col("n_True") > F.col("n_False")))
        part = F.when(F.col("m.meant").isNotNull(), F.when(F.col("m.place") < F.length("a"), "a").otherwise("b"))
        return self.keep.write(best.select("a", "mark", "b", belongs.alias("belongs"), F.coalesce("m.meant", "m.word").alias("meant"), part.alias("wrong")))

    def found(self) -> DataFrame:
        """record_id, field, line_no, kind: every line with furniture, a divided word or a misread one."""
        key = ["record_id", "field"]
        furniture = self.parsed.select(*key, F.explode("furniture").alias("line_no"), F.lit("furniture").alias("kind"))
        broken = self.parsed.select(*key, F.explode("broken").alias("x")).select(*key, "x.*").join(small(self.divided), ["a", "mark", "b"])
        hyphen = broken.where("not belongs").select(*key, F.col("line").alias("line_no"), F.lit("hyphen").alias("kind"))
        parts = broken.where("wrong is not null").select(*key, F.when(F.col("wrong") == "a", F.col("line")).otherwise(F.col("rest_line")).alias("line_no"), F.lit("misread").alias("kind"))
        words = self.parsed.select(*key, F.explode("tokens").alias("x")).select(*key, F.col("x.line").alias("line_no"), F.col("x.word").alias("word"))
        misread = words.join(small(self.misread.select("word")), "word").select(*key, "line_no", F.lit("misread").alias("kind"))
        return furniture.unionByName(hyphen).unionByName(parts).unionByName(misread).distinct()

    def repaired(self) -> DataFrame:
        """record_id, field, repaired: paragraphs on one line each, parted by blank lines; tables with one row a line.

        Without furniture; divided words joined and misread ones as they were meant, in the case that they had.
        """
        key = ["record_id", "field", "digest"]
        words = self.parsed.select(*key, F.explode("tokens.word").alias("word")).join(small(self.misread), "word").distinct()
        words = words.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "meant"))).alias("words"))
        broken = self.parsed.select(*key, F.explode("broken").alias("x")).select(*key, "x.a", "x.mark", "x.b").distinct().join(small(self.divided), ["a", "mark", "b"])
        broken = broken.groupBy(*key).agg(F.collect_list(F.struct("a", "mark", "b", "belongs", "meant", "wrong")).alias("joins"))
        # furniture depends on hints and context too; of equal texts of a record the one with most counts
        lines = self.parsed.groupBy(*key).agg(F.max_by("furniture", F.struct(F.size("furniture"), F.to_json("furniture"))).alias("furniture"))
        found = self.keep.write(lines.join(words, key, "left").join(broken, key, "left"))
        texts = self.rows.groupBy(*key).agg(F.first("text").alias("text"))
        return texts.join(found, key).select("record_id", "field", "text", "furniture", "words", "joins").mapInArrow(_rewrite, "record_id string, field string, repaired string")


def _as(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def rewrite(field: str, text: str, furniture: list[int], words: dict[str, str], joins: dict[tuple[str, str, str], tuple[bool, str, bool]]) -> str:
    """One text repaired; joins: (first part, mark, rest) to (mark belongs, word meant, misread)."""
    lines = [x.rstrip() for i, x in enumerate(text.split("\n"), 1) if i not in set(furniture)]

    def right(s: str) -> str:
        def one(m: re.Match) -> str:
            core = m[0].strip(_EDGE)
            meant = words.get(core.lower()) if core else None
            return m[0].replace(core, _as(meant, core), 1) if meant else m[0]
        return _TOKEN.sub(one, s) if words else s

    def join(a: str, mark: str, b: str) -> str:
        belongs, meant, wrong = joins.get((a.lower(), mark, b.lower()), (False, "", False))
        return _as(meant, a) if wrong else f"{a}-{b}" if belongs else a + b

    if field == "markdown":
        def cell(m: re.Match) -> str:
            return m[1] + words.get("#" + m[2].lower(), m[2])

        return "\n".join(right(re.sub(r"\s*<br\s*/?>\s*", " ", _CELL_LETTERS.sub(cell, _BROKEN.sub(lambda m: join(m[1], m[2], m[3]), x)))) for x in lines if x.strip())
    paragraphs: list[list[str]] = [[]]
    gap = False
    for x in lines:
        if not x.strip():
            gap = True
            continue
        # a gap ends a paragraph unless the sentence goes on after it, as at the end of a page
        last = paragraphs[-1][-1] if paragraphs[-1] else ""
        if gap and last and (_ENDED.search(last) or not (_DIVIDED.search(last) or x.lstrip()[:1].islower())):
            paragraphs.append([])
        gap = False
        paragraphs[-1].append(x.strip())
    out = []
    for p in paragraphs:
        joined = ""
        for x in p:
            m, first = _DIVIDED.search(joined), _FIRST.match(x)
            if m and first:
                joined = joined[: m.start()] + join(m[1], m[2], first[1]) + x[first.end() :]
            else:
                joined = f"{joined} {x}" if joined else x
        out.append(right(joined))
    return "\n\n".join(x for x in out if x)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for f, t, fu, w, j in zip(*(b.column(c).to_pylist() for c in ("field", "text", "furniture", "words", "joins"))):
            out.append(rewrite(f, t, fu, dict(w or []), {(x["a"], x["mark"], x["b"]): (x["belongs"], x["meant"], x["wrong"] is not None) for x in j or []}))
        yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("field"), pa.array(out, pa.string())], names=["record_id", "field", "repaired"])


def scanned_records(pdf: DataFrame, tables: DataFrame) -> DataFrame:
    """The records of ``pdf_evidence`` and ``table_data``: record_id, field, text, hints (titles of the document)."""
    hints = F.filter(F.array("anchor", "pdf_title"), lambda x: x.isNotNull())
    texts = pdf.select(F.col("document_id").alias("record_id"), hints.alias("hints"), F.inline(F.array(
        *(F.struct(F.lit(f).alias("field"), F.col(f).alias("text"), F.col(c).cast("string").alias("context")) for f, c in (("head_text", "front_text"), ("front_text", "head_text"))))))
    cells = tables.select(F.col("table_id").alias("record_id"), F.array().cast("array<string>").alias("hints"), F.lit("markdown").alias("field"), F.col("markdown").alias("text"), F.lit(None).cast("string").alias("context"))
    return texts.unionByName(cells)
