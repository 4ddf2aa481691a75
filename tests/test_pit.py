"""What a reader at an instant may see: boundaries, masking, overrides, refusals, and no look-ahead."""

import datetime

import pytest
from pyspark.sql import functions as F

from kairoframe.adapters import World
from kairoframe.operators import windows
from kairoframe.plans import pit

T = datetime.datetime
D = datetime.date
SEGMENT = "security_id string, symbol string, valid_from date, valid_to date, cik long, cik_available_at timestamp_ntz, available_at timestamp_ntz, end_available_at timestamp_ntz"
GOOD = [
    ("X", "A", D(2020, 1, 1), D(2021, 1, 1), 5, T(2020, 6, 1), T(2020, 1, 2), T(2021, 2, 1)),
    ("Y", "A", D(2021, 1, 1), None, None, None, T(2021, 2, 1), None),
]


def segments(spark, rows=GOOD):
    return spark.createDataFrame(rows, SEGMENT)


def test_three_facts_are_masked_apart(spark):
    at = lambda t: {r["security_id"]: (r["valid_to"], r["cik"]) for r in pit.masked_segments(segments(spark), t).collect()}
    assert at("2020-01-01 23:59:59.999999") == {}
    assert at("2020-01-02 00:00:00") == {"X": (None, None)}
    assert at("2020-06-01 00:00:00") == {"X": (None, 5)}
    assert at("2021-01-31 23:59:59.999999") == {"X": (None, 5)}
    assert at("2021-02-01 00:00:00") == {"X": (D(2021, 1, 1), 5), "Y": (None, None)}


def test_an_unknown_import_hides_nothing(spark):
    schema = "symbol string, t timestamp_ntz, close double, available_at timestamp_ntz, source string"
    vendor = spark.createDataFrame([("A", T(2020, 1, 1), 1.0, T(2020, 1, 2), "v"), ("B", T(2020, 1, 1), 2.0, T(2020, 1, 2), "v")], schema)
    late = spark.createDataFrame([("A", T(2020, 1, 1), 9.0, T(2020, 3, 1), "i")], schema)
    at = lambda t: sorted((r["symbol"], r["close"]) for r in pit.overridden(vendor, late, ["symbol", "t"], t).collect())
    assert at("2020-02-01 00:00:00") == [("A", 1.0), ("B", 2.0)]
    assert at("2020-03-01 00:00:00") == [("A", 9.0), ("B", 2.0)]
    assert at("2019-01-01 00:00:00") == []


@pytest.mark.parametrize(
    ("fault", "change"),
    [
        ("no_instant", lambda r: (*r[:6], None, r[7])),
        ("end_without_instant", lambda r: (*r[:7], None)),
        ("empty_interval", lambda r: (*r[:3], r[2], *r[4:])),
        ("end_known_early", lambda r: (*r[:7], T(2020, 12, 31))),
        ("filer_without_instant", lambda r: (*r[:5], None, *r[6:])),
    ],
)
def test_each_broken_row_is_refused(spark, fault, change):
    with pytest.raises(ValueError, match=fault):
        pit.checked_segments(segments(spark, [change(GOOD[0]), GOOD[1]]), "2022-01-01 00:00:00")
    assert pit.checked_segments(segments(spark), "2022-01-01 00:00:00").count() == 2


def test_double_owners_are_refused(spark):
    twice = segments(spark, [GOOD[0], GOOD[0], GOOD[1]])
    with pytest.raises(ValueError, match="duplicate_key"):
        pit.checked_segments(twice, "2022-01-01 00:00:00")
    early = segments(spark, [GOOD[0], (*GOOD[1][:2], D(2020, 12, 1), *GOOD[1][3:])])
    with pytest.raises(ValueError, match="overlap"):
        pit.checked_segments(early, "2022-01-01 00:00:00")


def test_a_table_needs_an_instant(spark):
    with pytest.raises(ValueError):
        pit.PitTable(spark.range(3))
    with pytest.raises(ValueError):
        pit.PitTable(segments(spark)).as_of("")


def test_features_never_look_ahead(spark):
    bars = World(spark, "/root/testdata/sf0.001").bars.filter("k <= 3").withColumn("security_id", F.col("symbol"))
    whole = windows.daily_features(bars).drop("prev_close")
    for day in ("1994-03-01", "1996-07-15"):
        cut = windows.daily_features(bars.filter(F.col("session_date") <= F.lit(day).cast("date"))).drop("prev_close")
        assert cut.exceptAll(whole).count() == 0


def test_empty_inputs(spark):
    none = World(spark, "/root/testdata/sf0.001").bars.limit(0)
    assert pit.visible_bars(none, none, "1998-01-01 00:00:00", segments(spark)).count() == 0
    assert pit.sessions(none, "1998-01-01 00:00:00", 5).count() == 0
