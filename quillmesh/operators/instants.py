"""Timestamps in mixed writings and zones to instants in UTC.

An ordered cascade of anchored patterns takes a value apart; the parts are then put together strictly, so that a
value that names no real date gives null. All of it is built-in column functions.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import strip_blanks

# Month names, by number, in English, German, French and Spanish, with usual abbreviations.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février fevrier févr fevr febrero",
    3: "march mar märz maerz mär mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_OFFSET = r"(?:\s*(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}))?"
_LETTERS = r"(?:\s+([A-Za-z]{1,5}))?"
_WORD = r"([\p{L}]{3,12})\.?"
_AMPM = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
#: Pattern, and the group of each part: y, mo (number), month (name), d, h, mi, s, f, ampm, zone, letters; a and b are day and month in the zone's order.
PATTERNS: list[tuple[str, str, dict[str, int]]] = [
    ("epoch_s", r"^(\d{10})$", {"epoch": 1}),
    ("epoch_ms", r"^(\d{13})$", {"epoch_ms": 1}),
    ("digits_date", r"^(\d{4})(\d{2})(\d{2})$", {"y": 1, "mo": 2, "d": 3}),
    ("year", r"^(\d{4})$", {"y": 1}),
    ("year_month", r"^(\d{4})-(\d{2})$", {"y": 1, "mo": 2}),
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt\s]\s*{_TIME}{_OFFSET}{_LETTERS})?$", {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "zone": 8, "letters": 9}),
    ("pdf", r"^D:(\d{4})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2}))?)?)?)?)?(?:(Z)(?:00'?(?:00'?)?)?|([+-]\d{2})'?(?:(\d{2})'?)?)?$", {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "zone": 7, "zh": 8, "zm": 9}),
    ("slashes", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_OFFSET}{_LETTERS})?$", {"a": 1, "b": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "ampm": 8, "zone": 9, "letters": 10}),
    ("slashes_year_first", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:\s+{_TIME}{_OFFSET}{_LETTERS})?$", {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "zone": 8, "letters": 9}),
    ("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_TIME}(?:\s*Uhr)?{_OFFSET}{_LETTERS})?$", {"d": 1, "mo": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "zone": 8, "letters": 9}),
    ("rfc", rf"^(?:\p{{L}}{{2,4}}\.?,?\s+)?(\d{{1,2}})\s+{_WORD}\s+(\d{{4}})\s+{_TIME}{_OFFSET}{_LETTERS}$", {"d": 1, "month": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "zone": 8, "letters": 9}),
    ("unix_date", rf"^\p{{L}}{{2,4}}\.?,?\s+{_WORD}\s+(\d{{1,2}})\s+{_TIME}(?:\s+([A-Za-z]{{1,5}}))?{_OFFSET}\s+(\d{{4}})$", {"month": 1, "d": 2, "h": 3, "mi": 4, "s": 5, "f": 6, "letters": 7, "zone": 8, "y": 9}),
    ("month_first", rf"^{_WORD}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_AMPM}{_OFFSET}{_LETTERS})?$", {"month": 1, "d": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "ampm": 8, "zone": 9, "letters": 10}),
    ("day_first", rf"^(\d{{1,2}})(?:\.|er|st|nd|rd|th)?\s+(?:de\s+)?{_WORD}\s+(?:de\s+)?(\d{{4}})(?:,?\s+(?:um\s+|at\s+|a las\s+|à\s+)?{_TIME}(?:\s*Uhr)?{_AMPM}{_OFFSET}{_LETTERS})?$", {"d": 1, "month": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "ampm": 8, "zone": 9, "letters": 10}),
    ("day_first_h", rf"^(\d{{1,2}})(?:er)?\s+{_WORD}\s+(\d{{4}}),?\s+(?:à\s+)?(\d{{1,2}})\s?h\s?(\d{{2}})?{_OFFSET}{_LETTERS}$", {"d": 1, "month": 2, "y": 3, "h": 4, "mi": 5, "zone": 6, "letters": 7}),
    ("month_year", rf"^{_WORD}\s+(?:de\s+)?(\d{{4}})$", {"month": 1, "y": 2}),
]


def zone_letters(spark: SparkSession) -> DataFrame:
    """What zone letters mean in each zone: tz_name, letters, offset (``+05:30``), one row each.

    Read from the IANA rules of every zone from 1990 on, so its size doesn't depend on the data (about 1,500 rows).
    A zone's own row with letters null tells known zones from unknown names.
    """
    out: dict[tuple[str, str | None], str | None] = {}
    for name in sorted(zoneinfo.available_timezones()):
        zone = zoneinfo.ZoneInfo(name)
        out[name, None] = None
        for year in range(1990, 2031):
            for month in (1, 4, 7, 10):
                t = dt.datetime(year, month, 15, tzinfo=zone)
                if (t.tzname() or "").isalpha():
                    out[name, t.tzname().upper()] = _offset(t.utcoffset())
        for (_, letters), offset in [x for x in out.items() if x[0][0] == name and x[0][1]]:
            if name.startswith("Australia/") and letters.startswith("A"):  # there also written without the A
                out.setdefault((name, letters[1:]), offset)
            if letters in ("CET", "CEST"):  # as written in German
                out.setdefault((name, {"CET": "MEZ", "CEST": "MESZ"}[letters]), offset)
    return spark.createDataFrame([(n, a, o) for (n, a), o in out.items()], "tz_name string, letters string, offset string")


def _offset(d: dt.timedelta) -> str:
    s = int(d.total_seconds())
    return f"{'-' if s < 0 else '+'}{abs(s) // 3600:02d}:{abs(s) // 60 % 60:02d}"


def _parts(v: Column, zone: Column) -> Column:
    """A struct of the parts of a value by the first pattern that matches; null if none does."""
    month_of = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for w in names.split() for x in (w, n)])
    out = None
    for name, pattern, groups in PATTERNS:
        def g(part: str, pattern: str = pattern, groups: dict[str, int] = groups) -> Column:
            if part not in groups:
                return F.lit(None).cast("string")
            t = F.regexp_extract(v, pattern, groups[part])
            return F.when(t != "", t)

        month: Column = g("mo").cast("int")
        day: Column = g("d").cast("int")
        if "month" in groups:
            month = F.try_element_at(month_of, F.lower(g("month")))
        if "a" in groups:
            first = zone == "America/New_York"
            month = F.when(first, g("a")).otherwise(g("b")).cast("int")
            day = F.when(first, g("b")).otherwise(g("a")).cast("int")
        offset = g("zone")
        if "zh" in groups:
            offset = F.coalesce(offset, F.concat(g("zh"), F.lit(":"), F.coalesce(g("zm"), F.lit("00"))))
        # +0530 and +05 as +05:30 and +05:00
        offset = F.when(offset == "Z", "+00:00").otherwise(F.regexp_replace(F.regexp_replace(offset, r"^([+-]\d{2})(\d{2})$", "$1:$2"), r"^([+-]\d{2})$", "$1:00"))
        s = F.struct(
            F.lit(name).alias("pattern"), g("epoch").cast("long").alias("epoch"), g("epoch_ms").cast("long").alias("epoch_ms"), g("y").cast("int").alias("y"), month.alias("mo"), F.lit("month" in groups).alias("named"),
            day.alias("d"), g("h").cast("int").alias("h"), g("mi").cast("int").alias("mi"), g("s").cast("int").alias("s"), g("f").alias("f"), F.lower(g("ampm")).alias("ampm"), offset.alias("offset"), F.upper(g("letters")).alias("letters"))
        out = F.when(v.rlike(pattern), s) if out is None else out.when(v.rlike(pattern), s)
    return out


def instants(df: DataFrame, value: str = "value", tz_name: str = "tz_name") -> DataFrame:
    """Adds ``instant`` (timestamp, UTC), ``epoch_s``, ``precision``, ``zone_from``, ``pattern`` and ``local_policy``.

    value: a string in any of PATTERNS, tz_name: the IANA zone of values without a zone of their own (null: UTC).
    A value of no pattern, or that names no real date (31 February, 0000-00-00), null, empty and blank ones give null
    in all added columns. So does a value without a zone of its own under a tz_name that is no IANA zone.

    - With slashes the month is first where tz_name is America/New_York, else the day; with dots the day.
    - Letters such as IST mean what they mean in the zone of tz_name; letters unknown there, what UTC and GMT mean
      anywhere; any other letters make the value unusable.
    - A local time that occurs twice means the first (``local_policy`` first); one that is skipped is read with the
      offset before the change (``local_policy`` before).
    - A value without time, day or month means the first moment of that day, month or year in its zone.
    - Seconds since 1970 are whole, fractions are dropped (towards the past).

    Other columns, also ones with these names on the input, are kept as they are unless the result replaces them.
    Rows are neither dropped nor merged.
    """
    added = ("instant", "epoch_s", "precision", "zone_from", "pattern", "local_policy")
    own = [c for c in df.columns if c not in added]
    v = strip_blanks(F.col(value).cast("string"))
    zone = F.coalesce(F.col(tz_name), F.lit("UTC"))
    letters = zone_letters(df.sparkSession)
    known = F.broadcast(letters.where("letters is null").select(F.col("tz_name").alias("__zone"), F.lit(True).alias("__known")))
    means = F.broadcast(letters.where("letters is not null").select(F.col("tz_name").alias("__zone"), F.col("letters").alias("__letters"), F.col("offset").alias("__offset")))
    # letters of one sign never name a zone but Z; AM and PM are taken before
    d = df.select(*own, zone.alias("__zone"), _parts(v, zone).alias("__p")).withColumn("__letters", F.col("__p.letters"))
    d = d.join(known, "__zone", "left").join(means, ["__zone", "__letters"], "left")
    p: Callable[[str], Column] = lambda x: F.col(f"__p.{x}")
    by_letters = F.coalesce("__offset", F.when(p("letters").isin("UTC", "GMT", "Z", "UT"), F.lit("+00:00")))
    used = F.when(p("offset").isNotNull(), p("offset")).when(p("letters").isNotNull(), by_letters).when(F.col("__known"), F.col("__zone"))
    hour = F.when(p("ampm").isNull(), p("h")).when(p("h").between(1, 12), p("h") % 12 + F.when(p("ampm") == "p", 12).otherwise(0))
    # a named month that is unknown must not count as one left out, nor an hour that is no hour as midnight
    complete = (~p("named") | p("mo").isNotNull()) & (p("h").isNull() | hour.isNotNull()) & (p("y") >= 1) & (F.coalesce(p("s"), F.lit(0)) < 60)
    seconds = (F.coalesce(p("s"), F.lit(0)) + F.coalesce(F.concat(F.lit("0."), p("f")).cast("double"), F.lit(0.0))).cast("decimal(8,6)")
    fields = [F.coalesce(p("y"), F.lit(0)), F.coalesce(p("mo"), F.lit(1)), F.coalesce(p("d"), F.lit(1)), F.coalesce(hour, F.lit(0)), F.coalesce(p("mi"), F.lit(0)), seconds]
    local = F.when(complete & used.isNotNull(), F.try_make_timestamp(*fields, F.coalesce(used, F.lit("UTC"))))
    epoch = F.coalesce(p("epoch"), F.floor(p("epoch_ms") / 1000))
    d = d.select(*own, "__p", "__zone", used.alias("__used"), F.coalesce(F.timestamp_micros(F.coalesce(p("epoch") * 1_000_000, p("epoch_ms") * 1000)), local).alias("instant"), F.try_make_timestamp_ntz(*fields).alias("__ntz"), epoch.alias("__epoch"))
    ok = F.col("instant").isNotNull()
    by_zone = ok & p("offset").isNull() & p("letters").isNull() & F.col("__epoch").isNull()
    utc = lambda t: F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.unix_micros(t) / F.lit(1_000_000).cast("decimal(18,6)")).cast("decimal(18,6)"))
    wall = lambda t: F.convert_timezone(F.lit("UTC"), F.coalesce(F.col("__used"), F.lit("UTC")), utc(t))
    later = [F.col("instant") + F.expr(f"interval {m} minutes") for m in (30, 60, 120)]
    twice = F.lit(False)
    for t in later:
        twice = twice | (wall(t) == F.col("__ntz"))
    return d.select(
        *own, "instant", F.when(ok, F.coalesce(F.col("__epoch"), F.floor(F.unix_micros("instant") / 1_000_000))).cast("long").alias("epoch_s"),
        F.when(ok, F.when(F.col("__epoch").isNotNull() | p("mi").isNotNull() | p("h").isNotNull(), "time").when(p("d").isNotNull(), "day").when(p("mo").isNotNull(), "month").otherwise("year")).alias("precision"),
        F.when(ok, F.when(F.col("__epoch").isNotNull(), "epoch").when(p("offset").isNotNull(), "offset").when(p("letters").isNotNull(), "letters").otherwise("default")).alias("zone_from"),
        F.when(ok, p("pattern")).alias("pattern"),
        F.when(by_zone, F.when(wall(F.col("instant")) != F.col("__ntz"), "before").when(twice, "first")).alias("local_policy"))
