import datetime as dt

from pyspark.sql import functions as F

from quillmesh.functions import dates as D

TITLES = {
    "Summary for Policymakers 09 March 2026.pdf": ("2026-03-09", "day", "full_date"), "newsTRAC-feb21.pdf": ("2021-02-01", "month", "month_year"), "Annual-Report-2024-25.pdf": ("2025-01-01", "year", "edition"),
    "ES2009CE09.pdf": None, "Post_2015_bulletin.pdf": None, "Agenda 2030 review 2019": ("2019-01-01", "year", "bare_year"), "Issue 8, Nov 2019": ("2019-11-01", "month", "month_year"), "minutes 10-02-2018.docx": ("2018-02-10", "day", "full_date"),
    "2024-09-15 call": ("2024-09-15", "day", "full_date"), "Oct - Dec 2016": ("2016-10-01", "month", "month_year"), "2024_September": ("2024-09-01", "month", "month_year"), "September 9 2024": ("2024-09-09", "day", "full_date"), "31-31-2018": ("2018-01-01", "year", "bare_year"), "": None, "water": None, "2013-25": ("2013-01-01", "year", "bare_year"),
}


def test_titles_state_dates(spark):
    df = spark.createDataFrame([(t,) for t in TITLES] + [(None,)], "t string")
    got = {r.t: r.d and (str(r.d.value), r.d.precision, r.d.kind) for r in df.select("t", D.title_date(F.col("t")).alias("d")).collect()}
    assert got == {**TITLES, None: None}


def test_dates_in_text_ranges_and_copyright(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(D.dates_in(F.lit("On 3rd May 2020, May 4, 2020, 2020-05-05, 06/05/2020 and 2020-13-40"))) == [dt.date(2020, 5, 3), dt.date(2020, 5, 4), dt.date(2020, 5, 5), dt.date(2020, 5, 6), dt.date(2020, 6, 5)]
    assert one(D.dates_in(F.lit(None).cast("string"))) == []
    day = F.lit("2020-05-05").cast("date")
    assert [tuple(one(D.checked_range(day, F.lit(e)))) for e in ("2020-06-01", "2019-01-01", "soon", " ")] == [(dt.date(2020, 6, 1), None), (None, "inverted"), (None, "end_invalid"), (None, None)]
    assert one(D.copyright_year(F.lit("© by 2014 Institute"))) == 2014 and one(D.copyright_year(F.lit("2014"))) is None
    assert [str(one(D.iso_start(F.lit(v)))) for v in ("2019", "2019-04", "2019-04-31", "x")] == ["2019-01-01", "2019-04-01", "None", "None"]
