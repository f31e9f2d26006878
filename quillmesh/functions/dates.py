"""Column functions on dates and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import let


def iso_date(value: Column) -> Column:
    """The leading ISO date of a string with anything after it; null for none or no real date."""
    return F.regexp_extract(value, r"^\s*(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def exclusive_end(inclusive: Column) -> Column:
    return F.date_add(inclusive, 1)


def inclusive_end(exclusive: Column) -> Column:
    return F.date_sub(exclusive, 1)


def floor_to(value: Column, precision: Column) -> Column:
    """The first day of a date's year or month, by its precision; the date itself for any other."""
    return F.when(precision == "year", F.trunc(value, "year")).when(precision == "month", F.trunc(value, "month")).otherwise(value)


def last_day_of(value: Column, precision: Column) -> Column:
    """The last day that a date of a precision covers."""
    return F.when(precision == "year", F.make_date(F.year(value), F.lit(12), F.lit(31))).when(precision == "month", F.last_day(value)).otherwise(value)


def period_overlaps(start: Column, end: Column, lo: Column, hi: Column, precision: Column | None = None, open_ended: Column | None = None) -> Column:
    """Whether a period meets [lo, hi). The start is floored to its precision; without an end it lasts through that precision, or for ever if open-ended."""
    precision = precision if precision is not None else F.lit(None).cast("string")
    begin = floor_to(start, precision)
    until = F.coalesce(end, last_day_of(start, precision))
    later = until >= lo
    if open_ended is not None:
        later = (open_ended & end.isNull()) | later
    return F.coalesce((begin < hi) & later, F.lit(False))


def display(value: Column, precision: Column) -> Column:
    """A date as its precision allows: 2021, Mar 2021 or 5 Mar 2021."""
    return F.when(precision == "year", F.date_format(value, "yyyy")).when(precision == "month", F.date_format(value, "MMM yyyy")).otherwise(F.date_format(value, "d MMM yyyy"))


def years_in(text: Column, first: int = 1980, last: int = 2029) -> Column:
    """The different years of a range that a text names, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: (y >= first) & (y <= last))))


def temporal_fit(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """How well a period fits a window [lo, hi): 1 within it, 0.75 if it covers it, 0.5 if it meets it, 0.25 if not or unknown."""
    last = F.coalesce(end, start)
    return (F.when(start.isNull(), 0.25).when((start >= lo) & (last < hi), 1.0).when((start <= lo) & (last >= F.date_sub(hi, 1)), 0.75)
            .when((start < hi) & (last >= lo), 0.5).otherwise(0.25))


# Names of months and how they are shortened; labels of numbers that are no days; words before years that a text looks towards.
MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
NUMBERED = r"([a-z]*(?:issue|iss|no|num|number|vol|volume|part|chapter|ch|edition|series|page|p)(?:\.\s*|\s+))?"
HORIZON = r"[a-z]*(?:post|agenda|vision|beyond|towards?|by|upto|until|till)[\s_-]+"
_B, _E, _Y, _GAP, _SEP = "(?:^|[^a-z0-9])", "(?:[^a-z0-9]|$)", r"(19[89]\d|20[0-3]\d)", r"[\s,._-]*", "[-./_]"
#: What the years of titles lie between.
FIRST_YEAR, LAST_YEAR = 1989, 2030
#: Ways in which a title states a date, the most precise first: pattern, precision, and the groups of year, month and day.
STATED = (
    (rf"{_B}{NUMBERED}(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}{_Y}{_E}", "day", 4, 3, 2), (rf"{_B}(){_Y}{_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}}){_E}", "day", 2, 3, 4),
    (rf"{_B}{NUMBERED}(\d{{1,2}})\s*(?:st|nd|rd|th)?{_GAP}{MONTH}{_GAP}{_Y}{_E}", "day", 4, 3, 2), (rf"{_B}(){MONTH}{_GAP}(\d{{1,2}})(?:st|nd|rd|th)?{_GAP}{_Y}{_E}", "day", 4, 2, 3),
    (rf"{_B}(){MONTH}\s*[-–/]\s*(?:{MONTH[1:]}{_GAP}{_Y}{_E}", "month", 3, 2, 0), (rf"{_B}(){MONTH}{_GAP}{_Y}{_E}", "month", 3, 2, 0), (rf"{_B}(){_Y}{_GAP}{MONTH}{_E}", "month", 2, 3, 0),
    (rf"{_B}(){MONTH}['_-]?(\d{{2}}){_E}", "month", 3, 2, 0),
)
SPAN = rf"{_B}{_Y}\s*[-–/]\s*(\d{{4}}|\d{{2}}){_E}"
BARE = rf"{_B}{_Y}{_E}"


def month_number(name: Column) -> Column:
    """The number of a month by its first three letters, or by digits."""
    at = F.instr(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), F.substring(name, 1, 3))
    return F.when(name.rlike("^[0-9]+$"), name.try_cast("int")).otherwise(F.floor((at + 3) / 4).cast("int"))


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers, null if there is none such."""
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def title_date(title: Column) -> Column:
    """The most precise date that a title or file name states: struct of value (its first day), precision and kind, or null.

    Day first where only numbers stand; a number with a label such as issue or volume is no day; two-digit years only
    right after a month. An edition of two years counts as the latter. Years that a text looks towards, such as agenda
    2030, are none; nor are years outside 1989 to 2030 and digits that letters or other digits touch.
    """
    def read(t: Column) -> Column:
        def found(pattern: str, precision: str, y: int, m: int, d: int) -> Column:
            part = lambda g: F.regexp_extract(t, pattern, g)
            year = part(y).try_cast("int")
            year = F.when(year < 100, F.when(year <= LAST_YEAR % 100, 2000 + year).when(year >= FIRST_YEAR % 100, 1900 + year)).otherwise(year)
            value = day_of(year, month_number(part(m)), part(d) if d else F.lit(1))
            ok = t.rlike(pattern) & (part(1) == "") & year.between(FIRST_YEAR, LAST_YEAR) & value.isNotNull()
            return F.when(ok, stated(value, precision, "full_date" if precision == "day" else "month_year"))

        def stated(value: Column, precision: str, kind: str) -> Column:
            return F.struct(value.alias("value"), F.lit(precision).alias("precision"), F.lit(kind).alias("kind"))

        first, second = F.regexp_extract(t, SPAN, 1).try_cast("int"), F.regexp_extract(t, SPAN, 2)
        follows = F.when(F.length(second) == 2, second.try_cast("int") == (first + 1) % 100).otherwise(second.try_cast("int") == first + 1)
        edition = F.when(follows & (first + 1).between(FIRST_YEAR, LAST_YEAR), stated(day_of(first + 1, F.lit(1), F.lit(1)), "year", "edition"))
        bare = F.regexp_extract(F.regexp_replace(t, f"{_B}{HORIZON}{_Y}(?=[^a-z0-9]|$)", " "), BARE, 1).try_cast("int")
        year = F.when(bare.between(FIRST_YEAR, LAST_YEAR), stated(day_of(bare, F.lit(1), F.lit(1)), "year", "bare_year"))
        return F.coalesce(*(found(*s) for s in STATED), edition, year)

    return let(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\.(?:pdf|docx?|xlsx?|pptx?|zip)$", " "), read)


def iso_start(value: Column) -> Column:
    """The first day of a year, year and month, or date in ISO form, with nothing after it; null for others."""
    p = r"^\s*(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?\s*$"
    part = lambda g: F.when(F.regexp_extract(value, p, g) != "", F.regexp_extract(value, p, g)).otherwise("01")
    return F.when(value.rlike(p), day_of(F.regexp_extract(value, p, 1), part(2), part(3)))


def checked_range(start: Column, end: Column) -> Column:
    """Struct of end and issue for a start (date) and an end (string): the end is kept where it is a date not before the start, else issue is end_invalid or inverted."""
    e = iso_date(end)
    given = F.trim(F.coalesce(end, F.lit(""))) != ""
    issue = F.when(given & e.isNull(), "end_invalid").when(e < start, "inverted")
    return F.struct(F.when(issue.isNull(), e).alias("end"), issue.alias("issue"))


def is_plausible(value: Column, this_year: int) -> Column:
    """Whether a date lies between 1990 and the next year."""
    return F.coalesce(F.year(value).between(1990, this_year + 1), F.lit(False))


# How a text claims its copyright.
COPYRIGHT = r"(?:©|\(c\)|copyright)\s*(?:©|\(c\))?\s*(?:by\s+)?((?:19|20)\d{2})"


def copyright_year(text: Column) -> Column:
    """The year of the first copyright statement of a text, or null."""
    return F.regexp_extract(F.lower(text), COPYRIGHT, 1).try_cast("int")


#: Ways in which dates stand in running text, with the groups of year, month and day; both orders of numbers with slashes.
IN_TEXT = ((r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3), (rf"\b(\d{{1,2}})(?:st|nd|rd|th)? {MONTH},? (\d{{4}})\b", 3, 2, 1), (rf"\b{MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b", 3, 1, 2), (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", 3, 2, 1), (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", 3, 1, 2))


def dates_in(text: Column) -> Column:
    """The different dates of a text, in order."""
    def one(p: str, y: int, m: int, d: int):
        return lambda x: day_of(F.regexp_extract(x, p, y), month_number(F.regexp_extract(x, p, m)), F.regexp_extract(x, p, d))

    def read(t: Column) -> Column:
        found = [F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), one(p, y, m, d)) for p, y, m, d in IN_TEXT]
        return F.array_sort(F.array_distinct(F.array_compact(F.concat(*found))))

    return let(F.lower(F.coalesce(text, F.lit(""))), read)


# How well a period fits the time asked about.
FIT_MATCH, FIT_PARTIAL, FIT_UNKNOWN, FIT_MISS = 1.0, 0.75, 0.5, 0.25


def fit_of_mode(mode: Column, start: Column, end: Column, open_ended: Column, today: Column, lo: Column, hi: Column) -> Column:
    """How well a period (end: its last day) fits the time that a question of a mode is about, [lo, hi) where it names one.

    What isn't known is neither favoured nor a miss. Open-ended periods last to the present.
    """
    last = F.when(~open_ended, end)
    current = F.when(start.isNull(), FIT_UNKNOWN).when(start > today, FIT_MISS).when(last.isNull() | (last >= today), FIT_MATCH).otherwise(FIT_MISS)
    past = F.when(start.isNull(), FIT_UNKNOWN).when(open_ended | last.isNull() | (last >= today), FIT_MISS).otherwise(FIT_MATCH)
    until = F.coalesce(last, today)
    contained = (lo.isNull() | (start >= lo)) & (hi.isNull() | (until < hi))
    window = F.when(lo.isNull() & hi.isNull() | start.isNull(), FIT_UNKNOWN).when((start >= hi) | (until < lo), FIT_MISS).when(contained, FIT_MATCH).otherwise(FIT_PARTIAL)
    return F.when(mode == "current", current).when(mode == "past", past).when(mode.isin("point_in_time", "date_range"), window).otherwise(FIT_UNKNOWN)


def known_period(start: Column, end: Column) -> tuple[Column, Column]:
    """Start and end of a period, both null where the end lies before the start."""
    turned = F.coalesce(end < start, F.lit(False))
    return F.when(~turned, start), F.when(~turned, end)
