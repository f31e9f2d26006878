import datetime as dt
import random
import zoneinfo

import pytest

from quillmesh.operators.instants import instants

CASES = [
    ("1313251266551", "Europe/Berlin", "2011-08-13T16:01:06"), ("1667089209", None, "2022-10-30T00:20:09"), ("2011", "Europe/Berlin", "2010-12-31T23:00:00"), ("20151029", None, "2015-10-29T00:00:00"),
    ("27.03.2011 02:16", "Europe/Berlin", "2011-03-27T01:16:00"), ("D:20220213222946-05'00'", "America/New_York", "2022-02-14T03:29:46"), ("D:20130527125541Z", "Asia/Kolkata", "2013-05-27T12:55:41"),
    ("D:2017", "UTC", "2017-01-01T00:00:00"), ("D:201703", None, "2017-03-01T00:00:00"), ("13 February 2022, 10:29 PM", "America/New_York", "2022-02-14T03:29:00"), ("13 février 2022 à 22h29", "America/New_York", "2022-02-14T03:29:00"),
    ("1er août 2010 à 14h54", None, "2010-08-01T14:54:00"), ("1. Juli 2011, 21:31 Uhr", "Europe/Berlin", "2011-07-01T19:31:00"), ("8. März 2023, 12:16 Uhr", None, "2023-03-08T12:16:00"), ("05/12/2012 3:36 PM", "America/New_York", "2012-05-12T19:36:00"),
    ("05/12/2012 12:36 AM", "Europe/Berlin", "2012-12-04T23:36:00"), ("Wed Apr  8 04:14:08 IST 2015", "Asia/Kolkata", "2015-04-07T22:44:08"), ("15.08.2018 15:34 IST", "Asia/Kolkata", "2018-08-15T10:04:00"), ("29.12.2010 11:00 AEDT", "Australia/Sydney", "2010-12-29T00:00:00"),
    ("07.11.2010 01:25 EST", "America/New_York", "2010-11-07T06:25:00"), ("07.11.2010 01:25", "America/New_York", "2010-11-07T05:25:00"), ("Mon, 08 Oct 2018 14:24:05 +1100", "Australia/Sydney", "2018-10-08T03:24:05"), ("  2018-07-20T04:49:19+00:00   ", "Europe/Berlin", "2018-07-20T04:49:19"),
    ("2017-10-16T22:06:39.950112+00:00", None, "2017-10-16T22:06:39"), ("2022-10-05 13:52:07 +0200", None, "2022-10-05T11:52:07"), ("2018-03", "Asia/Kolkata", "2018-02-28T18:30:00"), ("December 2022", "America/New_York", "2022-12-01T05:00:00"), ("July 11, 2022 08:40", "UTC", "2022-07-11T08:40:00"),
    ("2010-01-01 05:00 IST", "Asia/Jerusalem", "2010-01-01T03:00:00"), ("2010-06-01 05:00 IST", "Europe/Dublin", "2010-06-01T04:00:00"),
]
NONE = ["31/02/2019", "2018-06-31", "D:", "D:00000000000000", "0000-00-00 00:00:00", "2021-13-05T10:00:00Z", "30.02.2020 08:00", "n/a", "", "  ", None, "13:61", "5 Foo 2020, 10:00", "2020-01-01 25:00", "10/10/2020 13:00 PM", "12", "123456", "2020-01-01 10:00 QQQ", "x" * 100_000, "31 April 2020"]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, v, z) for i, (v, z, _) in enumerate(CASES)] + [(1000 + i, v, "Europe/Berlin") for i, v in enumerate(NONE)] + [(2000, "2020-01-01 10:00", "Mars/Base"), (2001, "2020-01-01 10:00Z", "Mars/Base")]
    return {r.id: r for r in instants(spark.createDataFrame(rows, "id int, value string, tz_name string")).collect()}


def seconds(iso):
    return int(dt.datetime.fromisoformat(iso).replace(tzinfo=dt.UTC).timestamp())


def test_writings(got):
    wrong = [(CASES[i][0], r.epoch_s and dt.datetime.fromtimestamp(r.epoch_s, dt.UTC).isoformat(), CASES[i][2]) for i, r in got.items() if i < 1000 and r.epoch_s != seconds(CASES[i][2])]
    assert not wrong


def test_no_real_dates(got):
    assert [NONE[i - 1000] for i, r in got.items() if 1000 <= i < 2000 and (r.instant is not None or r.epoch_s is not None)] == []


def test_unknown_zone(got):
    assert got[2000].instant is None and got[2001].epoch_s == seconds("2020-01-01T10:00:00")


def test_policies(got):
    by = {CASES[i][0]: r for i, r in got.items() if i < 1000}
    assert by["27.03.2011 02:16"].local_policy == "before" and by["07.11.2010 01:25"].local_policy == "first" and by["07.11.2010 01:25 EST"].local_policy is None
    assert by["2011"].precision == "year" and by["2018-03"].precision == "month" and by["20151029"].precision == "day" and by["1667089209"].precision == "time"


def test_local_times_against_zoneinfo(spark):
    r = random.Random(6)
    zones = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Australia/Lord_Howe", "Africa/Casablanca"]
    rows = []
    for _ in range(400):
        z = r.choice(zones)
        local = dt.datetime(2021, r.choice([3, 4, 10, 11]), 1) + dt.timedelta(minutes=r.randrange(30 * 24 * 60))
        rows.append((local.strftime("%Y-%m-%d %H:%M"), z, int(local.replace(tzinfo=zoneinfo.ZoneInfo(z), fold=0).timestamp())))
    d = instants(spark.createDataFrame(rows, "value string, tz_name string, want long")).collect()
    assert len(d) == 400 and all(x.epoch_s == x.want for x in d)


def test_session_zone_does_not_matter_and_columns(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        d = instants(spark.createDataFrame([("10.06.2021 08:00", "Europe/Berlin", "old", 3)], "value string, tz_name string, instant string, extra int"))
        r = d.first()
        assert r.epoch_s == seconds("2021-06-10T06:00:00") and r.extra == 3 and r.local_policy is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert instants(spark.createDataFrame([], "value string, tz_name string")).count() == 0
