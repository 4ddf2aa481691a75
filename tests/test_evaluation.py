"""Evaluation drivers on hand-made cases."""

import datetime
import itertools

import numpy as np
import pytest

from kairoframe.operators import evaluation, statistics

DAYS = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(60)]
AT = lambda k, h, m=0: datetime.datetime(2024, 1, 1, h, m) + datetime.timedelta(k)  # noqa: E731  winter: New York is UTC - 5


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([(d,) for d in DAYS], "session_date date")


def test_spans_and_entries(spark, calendar):
    trades = spark.createDataFrame([(1, "A", 1, AT(3, 14, 30), AT(5, 14, 30), 50.0, 10, 100.0), (1, "B", 1, AT(3, 14, 30), AT(5, 21), 5.0, 1, 100.0)], "run_id long, security_id string, leg int, entry_at timestamp, exit_at timestamp, pnl double, shares long, entry_price double")
    got = {r["security_id"]: r for r in evaluation.spans_of_trades(trades).collect()}
    assert (got["A"]["exit_at"], got["B"]["exit_at"]) == ("open", "close") and got["A"]["ret"] == 0.05 and got["A"]["key"] == f"A:{DAYS[3]}:1"
    decisions = spark.createDataFrame([(1, "A", AT(3, 1), "long", False), (1, "C", AT(60, 1), "long", False), (1, "D", AT(2, 1), "long", True), (1, "E", AT(2, 1), "flat", False)], "run_id long, security_id string, as_of timestamp, direction string, cancelled boolean")
    entries = evaluation.entries_of_run(decisions, calendar)
    assert [tuple(r) for r in entries.collect()] == [(1, "A", DAYS[3])]  # the evening of day 2 in New York; none after the last session
    assert [r["security_id"] for r in evaluation.undecided(trades, entries).collect()] == ["B"]


def test_prices_of_pool_members(spark, calendar):
    """A split and a child inside the span, a member without an exit price, a spin-off on raw prices."""
    prices = spark.createDataFrame([(s, d, o, c) for s, rows in {"A": [(3, 100.0, 101.0), (6, 60.0, 66.0)], "B": [(3, 10.0, 10.0)], "C": [(3, 10.0, 10.0), (6, 8.0, 9.0)]}.items() for k, o, c in rows for d in [DAYS[k]]], "security_id string, session_date date, open double, close double")
    splits = spark.createDataFrame([("A", DAYS[4], 2.0), ("A", DAYS[3], 5.0), ("A", DAYS[7], 5.0)], "security_id string, ex_date date, factor double")
    children = spark.createDataFrame([("A", DAYS[5], 3.0), ("A", DAYS[3], 50.0)], "security_id string, ex_date date, paid double")
    restarts = spark.createDataFrame([("C", DAYS[6])], "security_id string, ex_date date")
    spans = spark.createDataFrame([("v", "k1", "A", DAYS[3], DAYS[6], "open", 0.1), ("v", "k2", "A", DAYS[3], DAYS[6], "close", 0.1)], "variant string, key string, security_id string, entry_session date, exit_session date, exit_at string, ret double")
    members = spark.createDataFrame([(DAYS[2], m) for m in "ABC"] + [(DAYS[3], "Z")], "session_date date, member string")
    pools = evaluation.pools_for(spans, calendar, members)
    got = {(r["key"], r["member"]): r for r in evaluation.priced(pools, prices, splits, children, restarts, 0.0).collect()}
    assert set(m for _, m in got) == set("ABC") and got[("k1", "B")]["ret"] is None
    assert got[("k1", "A")]["ret"] == pytest.approx((60 * 2 + 3 * 2) / 100 - 1) and got[("k2", "A")]["ret"] == pytest.approx((66 * 2 + 6) / 100 - 1)
    assert got[("k1", "C")]["crossed"] and not got[("k1", "A")]["crossed"]
    panel = evaluation.priced(pools, prices, splits, children, restarts, 0.0)
    null = evaluation.family_nulls(panel, 40, 3).collect()
    assert len(null) == 80 and {round(r["ret"], 4) for r in null if r["key"] == "k1"} == {0.26, -0.2}
    crossings = evaluation.restart_crossings(evaluation.family_nulls(panel, 40, 3)).first()["crossings"]
    assert crossings == sum(r["crossed"] for r in null) > 0
    mean = {r["key"]: r["excess"] for r in evaluation.pool_excess(spans, panel).collect()}
    assert mean["k1"] == pytest.approx(0.1 - (0.26 - 0.2) / 2)


def test_planted_edge(spark, calendar):
    """Twenty securities on random walks; one gains 2 % a session after each of its entries: found; another one: not."""
    rng, rows = np.random.default_rng(8), []
    for i in range(20):
        p = 100.0
        for k, d in enumerate(DAYS):
            rows.append((f"S{i}", d, p, p))
            p *= 1 + rng.normal(0, 0.01) + (0.02 if i == 3 and k % 10 < 6 else 0)
    prices = spark.createDataFrame(rows, "security_id string, session_date date, open double, close double").cache()
    entries = spark.createDataFrame([(v, s, DAYS[k]) for v, s in (("edge", "S3"), ("none", "S7")) for k in (10, 20, 30, 40, 50)], "variant string, security_id string, session_date date")
    spans = evaluation.entry_spans(entries, prices, calendar, (5,), str(DAYS[-1]), 0.0)
    none = spark.createDataFrame([], "security_id string, ex_date date, factor double, paid double")
    panel = evaluation.priced(evaluation.pools_for(spans, calendar, prices.select("session_date", prices.security_id.alias("member"))), prices, none, none, none, 0.0)
    got = {r["variant"]: r for r in evaluation.entry_test(spans, panel, calendar, 200, 5, 200).collect()}
    assert got["edge:5"]["p_adjusted"] < 0.05 < got["none:5"]["p_adjusted"] and got["edge:5"]["excess_low"] > 0.05
    assert got["edge:5"]["trades"] == 5 and got["none:5"]["sd_ratio"] > 0
    tested = {r["variant"]: r["p_raw"] for r in evaluation.null_test(spans, panel, 200, 5).collect()}
    assert tested["edge:5"] == got["edge:5"]["p_raw"]
    excess = evaluation.pool_excess(spans, panel)
    closes = spark.createDataFrame([("S3", DAYS[18]), ("S3", DAYS[2])], "security_id string, session_date date")
    found = evaluation.reentry_difference(excess, closes, calendar, 10, 100, 1).collect()
    flagged = {r["session_date"]: r["reentry"] for r in statistics.reentries(excess.filter("security_id = 'S3'").withColumnRenamed("entry_session", "session_date"), closes, evaluation.numbered(calendar), 10).collect()}
    assert [r["variant"] for r in found] == ["edge:5"] and sorted(d for d, f in flagged.items() if f) == [DAYS[10], DAYS[20]]
    ranked = spark.createDataFrame([(DAYS[k - 1], s, r) for k in (10, 20, 30, 40, 50) for r, s in enumerate(["S3", "S5", "S7"])], "session_date date, security_id string, rank int")
    thirds = {r["tertile"]: r for r in evaluation.tertile_excess(excess, ranked, calendar, 100, 1).collect()}
    assert set(thirds) == {-1, 0, 2} and thirds[-1]["mean"] == pytest.approx(thirds[0]["mean"] - thirds[2]["mean"])


def test_benchmarks_side_by_side(spark):
    one = spark.createDataFrame([("SPY", DAYS[0], 1.0)], "symbol string, session_date date, equity double")
    two = spark.createDataFrame([(DAYS[0], 1.0)], "session_date date, equity double")
    assert {r["label"] for r in evaluation.benchmark_curves(one, two, "top 5").collect()} == {"SPY", "top 5"}


def test_null_returns_share_their_pool(spark):
    """20,000 spans of one day with a pool of 4,000: 80 million pairs used to be laid out. The draws are those of picks."""
    import time

    pool = spark.range(4_000).selectExpr("date'2024-01-05' as day", "concat('S', id) as security_id", "case when id % 3 > 0 then cast(id as double) end as ret")
    spans = spark.range(20_000).selectExpr("concat('v', id % 2) as variant", "concat('k', id) as key", "date'2024-01-05' as day").unionByName(spark.sql("select 'v0' as variant, 'lone' as key, date'2024-01-06' as day"))
    start = time.time()
    got = statistics.null_returns(spans, pool, 10, 3).filter("key in ('k7', 'k8') or perm = 9").collect()
    assert time.time() - start < 30 and len(got) == 20_000 + 2 * 9
    names = sorted(f"S{i}" for i in range(4_000))
    for key in ("k7", "k8"):
        want = [float(names[i][1:]) for i in statistics.picks(key, [int(n[1:]) % 3 > 0 for n in names], 10, 3)]
        assert [r["ret"] for r in sorted(got, key=lambda r: r["perm"]) if r["key"] == key] == want


def test_windows_share_their_pool(spark, calendar):
    """Pools priced for each window give every span the test that pools priced for each span give."""
    rng = np.random.default_rng(4)
    prices = spark.createDataFrame([(f"S{i}", d, p, p) for i in range(12) for k, d in enumerate(DAYS) for p in [float(rng.uniform(50, 150))] if (i + k) % 9], "security_id string, session_date date, open double, close double").cache()
    entries = spark.createDataFrame([(v, f"S{i}", DAYS[k]) for v in ("a", "b") for i in range(0, 12, 1 + (v == "b")) for k in (10, 11, 25)], "variant string, security_id string, session_date date")
    spans = evaluation.entry_spans(entries, prices, calendar, (5, 10), str(DAYS[-1]), 0.0)
    members = prices.select("session_date", prices.security_id.alias("member"))
    none = spark.createDataFrame([], "security_id string, ex_date date, factor double, paid double")
    each, shared = (evaluation.priced(evaluation.pools_for(x, calendar, members), prices, none, none, none, 0.0) for x in (spans, spans.select(*evaluation.WINDOW)))
    assert shared.count() < each.count() / 10
    one, other = ({r["variant"]: r for r in evaluation.entry_test(spans, x, calendar, 50, 5, 100).collect()} for x in (each, shared))
    drawn = {r["variant"]: r for r in evaluation.family_nulls(each, 50, 5).groupBy("variant").agg({"ret": "avg", "*": "count"}).collect()}
    assert sorted(one) == ["a:10", "a:5", "b:10", "b:5"] and sorted(other) == sorted(one)
    for v, r in other.items():
        assert all(r[c] == pytest.approx(one[v][c], abs=1e-12) for c in r.asDict() if c != "variant") and r["null_mean"] == pytest.approx(drawn[v]["avg(ret)"])


def test_spare_draws_are_one_stream():
    """Drawn many at a time, the spare draws are those of one at a time, and a pool with few priced members is not slow."""
    import time

    priced = [i % 400 == 7 for i in range(6_007)]
    got = statistics.picks("k", priced, 30, 9)
    rows = np.random.default_rng([9, statistics.key_seed("k")]).integers(0, len(priced), size=(30, statistics.CANDIDATES))
    for k, row in enumerate(rows):
        spare, at = np.random.default_rng([9, statistics.key_seed("k"), k]), next((int(i) for i in row if priced[i]), None)
        while at is None or not priced[at]:
            at = int(spare.integers(0, len(priced)))
        assert got[k] == at
    start = time.time()
    statistics.picks("k", priced, 5_000, 9)
    assert time.time() - start < 2


def test_null_returns_read_every_session(spark):
    """The query draws for each bar of each session, not of some, and its means are those of picks."""
    from harness import DATA

    from kairoframe import catalog
    from kairoframe.adapters import World
    from kairoframe.queries.pit import panel

    bars = sorted(((r["session_date"], r["security_id"], r["close"] / r["open"] - 1 if r["volume"] % 3 else None) for r in panel(World(spark, f"{DATA}/sf0.001")).collect()), key=lambda r: r[:2])
    pools = {d: [r for _, _, r in rows] for d, rows in itertools.groupby(bars, lambda r: r[0])}
    pools = {d: rets for d, rets in pools.items() if any(r is not None for r in rets)}
    rets = [[pools[d][i] for i in statistics.picks(f"{s}:{d}", [r is not None for r in pools[d]], 50, 7)] for d, s, _ in bars if d in pools]
    got = sorted(catalog.QUERIES["null_returns"](spark, f"{DATA}/sf0.001").collect())
    assert len({d.day for d in pools}) == 31 and [(r["perm"], r["variant"], r["spans"]) for r in got] == [(k, "a", len(rets)) for k in range(50)]
    assert np.allclose([r["mean"] for r in got], np.mean(rets, axis=0), atol=1e-12)


def test_null_totals_are_sums_of_null_returns(spark, monkeypatch):
    """Rows that are only spans or only members, spans of two variants and a copy, a day without a priced member."""
    monkeypatch.setattr(statistics, "CHUNK", 3)
    D1, D2, D3 = DAYS[:3]
    pool = [(d, f"S{i}", None if (i + k) % 3 == 0 or d == D3 else i + k / 10) for k, d in enumerate((D1, D2, D3)) for i in range(7)]
    spans = [(v, f"k{i}", d) for d in (D1, D2, D3, DAYS[4]) for v in "ab" for i in range(10 if v == "a" else 2)] + [("a", "k1", D1)]
    rows = [(d, "b" if s == "S5" else None, s if s == "S5" else None, s, r) for d, s, r in pool] + [(d, v, k, None, None) for v, k, d in spans]
    got = {(r["variant"], r["perm"]): r for r in statistics.null_totals(spark.createDataFrame(rows, "day date, variant string, key string, security_id string, ret double"), 6, 2).groupBy("variant", "perm").sum("n", "s").collect()}
    some = [(v, k, d) for v, k, d in [*spans, *(("b", "S5", d) for d in (D1, D2))] if d in (D1, D2)]
    one = statistics.null_returns(spark.createDataFrame(some, "variant string, key string, day date"), spark.createDataFrame(pool, "day date, security_id string, ret double"), 6, 2)
    want = {(r["variant"], r["perm"]): r for r in one.groupBy("variant", "perm").agg({"*": "count", "ret": "sum"}).collect()}
    assert sorted(got) == sorted(want) and len(want) == 12
    assert all(r["sum(n)"] == want[k]["count(1)"] and r["sum(s)"] == pytest.approx(want[k]["sum(ret)"], abs=1e-12) for k, r in got.items())
