from datetime import datetime, timezone

import pytest

from loomtrace.functions.zones import zone_table
from loomtrace.operators.timestamps import convert, normalise_times

TABLES = {z: zone_table(z) for z in ("Europe/Berlin", "America/New_York", "UTC", "Asia/Shanghai")}


def utc(text, zone="Europe/Berlin", order="DMY"):
    v, ok = convert([text], [zone], [order], TABLES)
    return datetime.fromtimestamp(v[0] / 1e6, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f") if ok[0] else None


@pytest.mark.parametrize(
    "text, zone, order, want",
    [
        ("2024-10-27 02:30:00", "Europe/Berlin", "DMY", "2024-10-27 00:30:00.000000"),
        ("2025-03-30 02:30:00", "Europe/Berlin", "DMY", "2025-03-30 01:30:00.000000"),
        ("03/10/2024 2:30:00 AM", "America/New_York", "MDY", "2024-03-10 07:30:00.000000"),
        ("11/03/2024 1:18:32 AM", "America/New_York", "MDY", "2024-11-03 05:18:32.000000"),
        ("Sun Oct 26 02:27:37 CET 2025", "Europe/Berlin", "DMY", "2025-10-26 01:27:37.000000"),
        ("2025-10-26 02:27:37 CST", "Asia/Shanghai", "YMD", "2025-10-25 18:27:37.000000"),
        ("{'$date': {'$numberLong': '1759975651991'}}", "UTC", "DMY", "2025-10-09 02:07:31.991000"),
        ("1717263065156301", "UTC", "DMY", "2024-06-01 17:31:05.156301"),
        ("1738050927.310", "UTC", "DMY", "2025-01-28 07:55:27.310000"),
        ("2024-06-01T19:40:30.946421387Z", "UTC", "DMY", "2024-06-01 19:40:30.946421"),
        ("20240601T230312+08", "UTC", "DMY", "2024-06-01 15:03:12.000000"),
        ("2024-05-19T12:57:06+05:30", "UTC", "DMY", "2024-05-19 07:27:06.000000"),
        (" 2024-06-02 04:01:59 -0700", "UTC", "DMY", "2024-06-02 11:01:59.000000"),
        ("Sat, 22 Jun 2024 14:13:29 GMT", "Europe/Berlin", "DMY", "2024-06-22 14:13:29.000000"),
        ("1 Jun 2024, 12:36:20", "UTC", "DMY", "2024-06-01 12:36:20.000000"),
        ("2024-06-01 07:05", "UTC", "DMY", "2024-06-01 07:05:00.000000"),
        ("2024-06-01", "UTC", "DMY", "2024-06-01 00:00:00.000000"),
        ("12/01/2024 10:00:00", "UTC", "DMY", "2024-01-12 10:00:00.000000"),
        ("06/05/2024 12:12:44 PM", "UTC", "MDY", "2024-06-05 12:12:44.000000"),
        ("06/05/2024 12:12:44 AM", "UTC", "MDY", "2024-06-05 00:12:44.000000"),
    ],
)
def test_shapes(text, zone, order, want):
    assert utc(text, zone, order) == want


@pytest.mark.parametrize("text", [None, "", "  ", "pending", "NaT", "N/A", "0000-00-00 00:00:00", "2025-02-30 10:00:00", "2025-13-01 10:00:00", "x" * 500, "2025-01-01 10:00:00 QQQ"])
def test_no_instant(text):
    assert utc(text) is None


def test_unknown_zone_still_reads_own_zones():
    assert utc("2024-06-01 07:05", "Mars/Olympus") is None
    assert utc("2024-06-01T07:05:00Z", "Mars/Olympus") is not None


def test_frame(spark):
    rows = [(1, "2024-06-01 07:05", " ChatGPT ", "x"), (2, "2024-06-01 07:05", None, "grok_conv_1"), (3, None, "claude", "c"), (4, "2024-06-01 07:05", "other", None), (5, "1717263065", None, None)]
    clock = spark.createDataFrame([("chatgpt", "Europe/Berlin", "DMY"), ("grok", "America/New_York", "MDY"), ("claude", "UTC", "DMY")], "platform string, wall_zone string, date_order string")
    turns = spark.createDataFrame(rows, "row_id long, time string, platform string, conv_id string")
    got = {r.row_id: r.utc_us for r in normalise_times(turns, clock).collect()}
    assert got[1] == 1717218300_000000 and got[2] == 1717239900_000000 and got[5] == 1717263065_000000 and set(got) == {1, 2, 5}
    assert normalise_times(turns.limit(0), clock).count() == 0
    assert normalise_times(turns, clock.limit(0)).count() == 1


def test_matches_zoneinfo():
    from zoneinfo import ZoneInfo

    import numpy as np

    for name, t in TABLES.items():
        for wall in range(0, 60 * 365 * 86_400, 86_400 * 3 + 1234):
            naive = datetime(1970, 1, 1) + __import__("datetime").timedelta(seconds=wall)
            want = naive.replace(tzinfo=ZoneInfo(name)).timestamp()
            assert t.wall_to_utc(np.array([wall]))[0] == want, (name, naive)
