"""Texts to instants: a table of cases, and random instants written in many formats and read back."""

from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relgrain.functions.instants import micros_text, micros_to_ntz, normalize_instants

CASES = [
    # text, zone, order, outcome
    ("2022-01-01T08:16:17.096547Z", None, None, "2022-01-01T08:16:17.096547Z"),
    ("2022-01-04t08:57:10z", None, None, "2022-01-04T08:57:10.000000Z"),
    ("2022-01-02T18:13:36.266201999Z", None, None, "2022-01-02T18:13:36.266201Z"),
    ("2022-01-01 08:40:23,098", "Europe/Berlin", None, "2022-01-01T07:40:23.098000Z"),
    ("2022-07-01 19:01:19 Europe/Berlin", "America/New_York", None, "2022-07-01T17:01:19.000000Z"),
    ("2022-01-01 22:40:37 America/New_York", None, None, "2022-01-02T03:40:37.000000Z"),
    ("2022-01-01 04:40:37 America/Los_Angeles", None, None, "2022-01-01T12:40:37.000000Z"),
    ("2022-01-02T04:17:43+01:00[Europe/Berlin]", None, None, "2022-01-02T03:17:43.000000Z"),
    ("2022-01-06 18:30:59.3392+00", None, None, "2022-01-06T18:30:59.339200Z"),
    ("2022-06-12 05:45:00+0530", None, None, "2022-06-12T00:15:00.000000Z"),
    ("Fri, 10 Feb 2023 01:21:33 -0500", None, None, "2023-02-10T06:21:33.000000Z"),
    ("Fri, 10 Feb 2023 01:21:33 -0500 (EST)", None, None, "2023-02-10T06:21:33.000000Z"),
    ("01 Apr 2022 16:21:33 BST", "America/New_York", None, "2022-04-01T15:21:33.000000Z"),
    ("2022-11-06 01:30:00 EDT", "America/New_York", None, "2022-11-06T05:30:00.000000Z"),
    ("2022-11-06 01:30:00 EST", "America/New_York", None, "2022-11-06T06:30:00.000000Z"),
    ("2022-11-06 01:30:00", "America/New_York", None, "ambiguous"),
    ("2022-03-13 02:30:00", "America/New_York", None, "nonexistent"),
    ("20221030022944", "Europe/Berlin", None, "ambiguous"),
    ("2022-10-02 02:10:00", "Australia/Lord_Howe", None, "nonexistent"),
    ("2022-04-03 01:45:00", "Australia/Lord_Howe", None, "ambiguous"),
    ("2022-03-27", "Europe/Berlin", None, "2022-03-26T23:00:00.000000Z"),
    ("2022-10-16", "America/Sao_Paulo", None, "2022-10-16T03:00:00.000000Z"),
    ("2018-11-04", "America/Sao_Paulo", None, "2018-11-04T03:00:00.000000Z"),  # midnight was skipped
    ("2018-11-04 00:30", "America/Sao_Paulo", None, "nonexistent"),
    ("2022-11-06", "America/Havana", None, "2022-11-06T04:00:00.000000Z"),  # midnight came twice
    ("01/02/2022 03:04:05 PM", "UTC", "MDY", "2022-01-02T15:04:05.000000Z"),
    ("01/02/2022 12:04:05 am", "UTC", "DMY", "2022-02-01T00:04:05.000000Z"),
    ("1/2/22 3:04", "UTC", "DMY", "2022-02-01T03:04:00.000000Z"),
    ("22/2/1 3:04", "UTC", "YMD", "2022-02-01T03:04:00.000000Z"),
    ("13/02/2022", "UTC", None, "2022-02-13T00:00:00.000000Z"),
    ("02/13/2022", "UTC", None, "2022-02-13T00:00:00.000000Z"),
    ("02/03/2022", "UTC", None, "invalid"),
    ("02.03.2022", "UTC", None, "2022-03-02T00:00:00.000000Z"),
    ("13/02/2022", "UTC", "MDY", "invalid"),
    ("April 11, 2024 3:25 AM", "UTC", None, "2024-04-11T03:25:00.000000Z"),
    (" 　2022-01-01 00:00:00\t\n", "UTC", None, "2022-01-01T00:00:00.000000Z"),
    ("9 September 2023 09:00", "Asia/Kolkata", None, "2023-09-09T03:30:00.000000Z"),
    ("1641118930", None, None, "2022-01-02T10:22:10.000000Z"),
    ("1641226207.3621", None, None, "2022-01-03T16:10:07.362100Z"),
    ("1641044945866", None, None, "2022-01-01T13:49:05.866000Z"),
    ("1641274618761439", None, None, "2022-01-04T05:36:58.761439Z"),
    ("1641274618761439123", None, None, "2022-01-04T05:36:58.761439Z"),
    ("20220104", "UTC", None, "2022-01-04T00:00:00.000000Z"),
    ("20220104T055643Z", None, None, "2022-01-04T05:56:43.000000Z"),
    ("20220102T135158+0000", None, None, "2022-01-02T13:51:58.000000Z"),
    ("2024-02-29", "UTC", None, "2024-02-29T00:00:00.000000Z"),
    ("2022-01-01 10:00:00", None, None, "no_zone"),
    ("2022-01-01 10:00:00", "Nowhere/Land", None, "no_zone"),
    ("2022-01-01 10:00:00 XYZ", "UTC", None, "no_zone"),
    *[(t, "UTC", "YMD", "invalid") for t in ("", "  \t", "null", "N/A", "-", "TBD", "yesterday 10:50", "0000-00-00", "0000-00-00 00:00:00", "2023-02-29", "2022-00-14", "2022-13-01", "2023-11-41", "2023-09-28 23:72:05", "2022-01-01 24:00:00", "2022-01-01T10:00:60Z", "2022-01-01T10:00:00+25:00", "13:00 PM", "31.04.2022", "1" * 11, "1/2/3", "2022-01-01 10", "x" * 100_000)],
    ("01/02/2022 13:04:05 PM", "UTC", "MDY", "invalid"),
    ("01/02/2022 00:04:05 AM", "UTC", "MDY", "invalid"),
    (None, "UTC", "MDY", None),
]


def outcomes(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, z string, o string")
    out = normalize_instants(df, "t", "z", "o")
    return {r["i"]: r["x"] for r in out.select("i", F.coalesce("instant_reason", micros_text(F.col("instant_us"))).alias("x")).collect()}


def test_cases(spark):
    got = outcomes(spark, [c[:3] for c in CASES])
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[3]]
    assert not wrong


@pytest.mark.parametrize("zone", ["America/St_Johns"])
def test_session_zone_does_not_matter(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = outcomes(spark, [c[:3] for c in CASES])
        assert [got[i] for i in range(len(CASES))] == [c[3] for c in CASES]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_names_may_clash_and_tables_be_empty(spark):
    df = spark.createDataFrame([(1, "2022-01-01T00:00:00Z", 5, 6)], "instant_us int, t string, __c int, __l int")
    out = normalize_instants(df, "t")
    assert sorted(out.columns) == ["__c", "__l", "instant_reason", "instant_us", "t"]
    assert out.first()["instant_us"] == 1640995200000000 and out.first()["__c"] == 5
    assert normalize_instants(df.limit(0), "t").count() == 0
    assert out.select(micros_to_ntz(F.col("instant_us")).cast("string")).first()[0] == "2022-01-01 00:00:00"


ZONES = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Los_Angeles", "Europe/London"]


def brute(local, zone):
    """Instants at which the zone's clocks show the local time, by trying every quarter of an hour."""
    z = ZoneInfo(zone)
    found = set()
    for q in range(-60, 61):
        u = (local + timedelta(minutes=15 * q)).replace(tzinfo=UTC)
        if u.astimezone(z).replace(tzinfo=None) == local:
            found.add(u)
    return sorted(found)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.datetimes(datetime(2021, 1, 1), datetime(2025, 1, 1)), st.sampled_from(ZONES), st.integers(0, 7)), min_size=60, max_size=60))
def test_random_locals(spark, rows):
    texts, expected = [], []
    for at, zone, how in rows:
        t = at.replace(microsecond=0) if how else at
        text, order = [
            (t.strftime("%Y-%m-%d %H:%M:%S.%f"), "DMY"), (t.strftime("%d.%m.%Y %H:%M:%S"), "DMY"), (t.strftime("%m/%d/%Y %I:%M:%S %p"), "MDY"), (t.strftime("%Y%m%d%H%M%S"), None),
            (t.strftime("%a, %d %b %Y %H:%M:%S"), None), (t.strftime("%Y-%m-%dT%H:%M:%S"), None), (f"{t.year}-{t:%m-%d %H:%M:%S}", "YMD"), (f"{t.day} {t:%B %Y %H:%M:%S}", None),
        ][how]
        found = brute(t, zone)
        texts.append((text, zone, order))
        expected.append("nonexistent" if not found else "ambiguous" if len(found) > 1 else found[0].strftime("%Y-%m-%dT%H:%M:%S.%fZ"))
    got = outcomes(spark, texts)
    assert [got[i] for i in range(len(texts))] == expected


def test_every_change_of_a_year(spark):
    """Each half hour around every change of offset in 2022."""
    rows, expected = [], []
    for zone in ZONES:
        z, t = ZoneInfo(zone), datetime(2022, 1, 1, tzinfo=UTC)
        while t.year == 2022:
            if t.astimezone(z).utcoffset() != (t + timedelta(hours=1)).astimezone(z).utcoffset():
                for q in range(-8, 9):
                    local = (t.astimezone(timezone.utc).replace(tzinfo=None) + t.astimezone(z).utcoffset()) + timedelta(minutes=30 * q)
                    found = brute(local, zone)
                    rows.append((local.strftime("%Y-%m-%d %H:%M:%S"), zone, None))
                    expected.append("nonexistent" if not found else "ambiguous" if len(found) > 1 else found[0].strftime("%Y-%m-%dT%H:%M:%S.000000Z"))
            t += timedelta(hours=1)
    got = outcomes(spark, rows)
    assert [got[i] for i in range(len(rows))] == expected and {"nonexistent", "ambiguous"} <= set(expected)
