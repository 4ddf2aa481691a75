"""Operators without a SQL twin, and the parts of others, against small known cases."""

import datetime
import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kairoframe.functions import text
from kairoframe.operators import aggregates, identity, joins, recurrences, simulation, statistics, windows
from kairoframe.sources import tables

D = datetime.date


def test_recurrences_against_pandas(spark):
    r = np.random.default_rng(1)
    xs = np.round(100 + np.cumsum(r.normal(0, 1, 80)), 4).tolist()
    df = spark.createDataFrame([("a", D(2020, 1, 1) + datetime.timedelta(i), x) for i, x in enumerate(xs)], "k string, d date, x double")
    made = recurrences.along(df, "k", "d", "x", e=lambda: recurrences.ema(20), w=lambda: recurrences.rma(5), bx=recurrences.histogram)
    rows = sorted(made.collect(), key=lambda r: r["d"])
    e, w, bx = ([r[c] for r in rows] for c in ("e", "w", "bx"))
    assert np.allclose(e, pd.Series(xs).ewm(alpha=2 / 21, adjust=False).mean())
    tail = pd.Series([np.mean(xs[:5]), *xs[5:]]).ewm(alpha=0.2, adjust=False).mean()
    assert w[:4] == [None] * 4 and np.allclose(w[4:], tail)
    assert bx[:5] == [None] * 5 and all(-50 <= v <= 50 for v in bx[5:])
    flat = recurrences.rsi(5)
    assert [flat(3.0) for _ in range(9)][5:] == [100.0] * 4


def test_recurrences_are_linear(spark):
    """64,000 values of one key and of many, across batches; a missing value makes the rest missing, for its key alone."""
    import time

    df = spark.range(64_000).selectExpr("'a' as k", "id as d", "cast(id % 97 as double) as x").unionByName(spark.range(100).selectExpr("'b' as k", "id as d", "case when id <> 50 then 1.0d end as x"))
    recurrences.along(df, "k", "d", "x", e=lambda: recurrences.ema(9)).count()
    start = time.time()
    got = recurrences.along(df, "k", "d", "x", e=lambda: recurrences.ema(9), bx=recurrences.histogram).selectExpr("k", "count(e) over (partition by k) as n", "d").distinct().groupBy("k").agg({"n": "max", "d": "count"}).collect()
    assert time.time() - start < 20
    assert {r["k"]: (r["max(n)"], r["count(d)"]) for r in got} == {"a": (64_000, 64_000), "b": (50, 100)}
    medians = windows.crossing_medians(spark.range(20_000).selectExpr("'a' as security_id", "id as session_date", "id % 3 = 0 as crossing", "cast((id * 7919) % 1000 as double) as high", "1.0d as low", "1.0d as fv"), None)
    last = medians.orderBy("session_date", ascending=False).first()
    assert last["hu"] == float(np.median([(i * 7919) % 1000 for i in range(0, 20_000, 3)])) and last["ld"] == 1.0
    some = windows.crossing_medians(spark.createDataFrame([("a", i, True, float(v), 1.0, 1.0) for i, v in enumerate([5, 1, 9, 9, 2])], "security_id string, session_date int, crossing boolean, high double, low double, fv double"), 3)
    assert [r["hu"] for r in some.orderBy("session_date").collect()] == [5, 3, 5, 9, 9]


def test_first_after_a_moment(spark):
    at = lambda *x: datetime.datetime(2020, 1, *x)
    days = spark.createDataFrame([(D(2020, 1, d), at(d, 9, 30)) for d in (2, 3, 7)], "session_date date, opens timestamp_ntz")
    left = spark.createDataFrame([(1, at(1, 0)), (2, at(2, 9, 29)), (3, at(2, 9, 30)), (4, at(3, 12)), (5, at(7, 9, 30)), (6, None), (7, at(6, 23))], "id int, ts timestamp_ntz")
    got = {r["id"]: r["session_date"] and r["session_date"].day for r in joins.first_after(left, "ts", days, "opens", "session_date").collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 7, 5: None, 6: None, 7: 7}


def test_leg_exits():
    rules = simulation.LegRules(zone_atr=0.5, zone_cap_pct=10.0, hard_atr=1.5, observe_days=2, trail_atr=3.0, max_sessions=4, bps=0.0)
    day = [D(2020, 1, i + 1) for i in range(9)]
    run = lambda bars: simulation.run_leg(day[: len(bars)], bars, 2.0, 10, rules)
    assert run([(100, 101, 96.5, 99.5)])["reason"] == "hard" and run([(100, 101, 96.5, 99.5)])["exit_price"] == 97.0
    assert run([(100, 103, 99, 102), (96, 97, 95, 96)])["reason"] == "hard_gap"
    assert run([(100, 101, 98, 98.5), (99, 99, 98, 98)])["reason"] == "break"
    assert run([(100, 101, 99, 100)] * 3)["reason"] == "observe_timeout"
    up = [(100 + 2 * i, 103 + 2 * i, 99 + 2 * i, 102 + 2 * i) for i in range(6)]
    assert run(up)["reason"] == "max_sessions" and run(up)["held"] == 4
    assert run(up[:2])["reason"] == "open_at_end" and run([]) is None
    r = run([(100, 103, 99, 102), (96, 97, 95, 96)])
    assert r["pnl"] == 10 * (96 - 100) and r["r_multiple"] == pytest.approx(-4 / 3) and r["mae_pct"] == pytest.approx(-4) and r["mfe_pct"] == pytest.approx(3)


def test_stream_equals_batch(spark, tmp_path):
    from kairoframe.streaming import legs

    r, rules = np.random.default_rng(2), simulation.LegRules(max_sessions=6)
    rows = []
    for s in "abcd":
        p = 100.0
        for i in range(12):
            o = p * (1 + r.normal(0, 0.01))
            c = o * (1 + r.normal(0, 0.02))
            rows.append((s, D(2020, 1, 1) + datetime.timedelta(i), o, max(o, c) * 1.005, min(o, c) * 0.995, c))
            p = c
    schema = "security_id string, session_date date, open double, high double, low double, close double"
    for part in range(3):
        spark.createDataFrame([x for x in rows if (x[1] - D(2020, 1, 1)).days // 4 == part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = legs.stepped(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), rules, 2.0, 10).writeStream.format("memory").queryName("legs_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {x["security_id"]: (x["exit_day"], round(x["exit_price"], 9), x["reason"]) for x in spark.sql("select * from legs_out").collect()}
    for s in "abcd":
        own = [x for x in rows if x[0] == s]
        made = simulation.run_leg([x[1] for x in own], [x[2:] for x in own], 2.0, 10, rules)
        assert (got.get(s) == (made["exit_day"], round(made["exit_price"], 9), made["reason"])) or (made["reason"] == "open_at_end" and s not in got)


def test_windowed_stream(spark, tmp_path):
    from kairoframe.streaming import legs

    spark.sql("select timestamp_ntz'2020-01-01 20:00:00' as available_at, 5L as volume union all select timestamp_ntz'2020-01-01 21:00:00', 0L union all select timestamp_ntz'2020-01-09 20:00:00', 7L").selectExpr("cast(available_at as timestamp) available_at", "volume").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("available_at timestamp, volume long").parquet(f"{tmp_path}/in")
    q = legs.windowed(stream, "1 day", "1 day").writeStream.format("memory").queryName("win_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["bars"], r["traded"], r["volume"]) for r in spark.sql("select * from win_out").collect()) == [(1, 1, 7), (2, 1, 5)]


def test_draws_are_keyed():
    priced = [True, False, True, True]
    a, b = statistics.picks("x:1", priced, 200, 7), statistics.picks("x:1", priced, 200, 7)
    assert a == b and set(a) == {0, 2, 3} and a != statistics.picks("x:2", priced, 200, 7)
    fewer = statistics.picks("x:1", [True, False, True, False], 200, 7)
    assert all(x == y for x, y in zip(a, fewer, strict=True) if x != 3)  # others keep their pick
    with pytest.raises(ValueError):
        statistics.picks("x", [False], 3, 1)


def test_bootstrap_interval_covers_the_mean():
    r = np.random.default_rng(3)
    v, c = r.normal(1, 1, 400), np.repeat(np.arange(40), 10)
    sums = lambda x, f=None: np.column_stack([np.bincount(c, w * g) for g in ([np.ones(400)] if f is None else [f, 1 - f]) for w in (x, np.ones(400))])
    mean, low, high = statistics.resampled(sums(v), 500, 1)
    assert low < mean < high and abs(mean - v.mean()) < 1e-12
    assert statistics.resampled(sums(v)[:1], 10, 1) == (v[:10].mean(),) * 3
    diff, lo, hi = statistics.resampled(sums(v + c % 2, (c % 2).astype(float)), 500, 1)
    assert lo < diff < hi and 0.5 < diff < 1.5
    # Each draw's total is that of the clusters it picked.
    picked = np.random.default_rng(5).integers(0, 40, size=(7, 40))
    assert np.allclose(statistics.drawn_totals(sums(v), 7, 5)[:, 0], sums(v)[:, 0][picked].sum(axis=1))
    with pytest.raises(ValueError):
        statistics.resampled(sums(v, np.zeros(400)), 5, 1)


def test_planted_edge_is_found_and_its_absence_is_not(spark):
    r = np.random.default_rng(4)
    null = [(k, v, float(x)) for v in "ab" for k in range(100) for x in r.normal(0, 1, 30)]
    real = [("a", float(x)) for x in r.normal(1.2, 1, 30)] + [("b", float(x)) for x in r.normal(0, 1, 30)]
    got = {x["variant"]: x for x in statistics.max_statistic(spark.createDataFrame(real, "variant string, ret double"), spark.createDataFrame(null, "perm long, variant string, ret double")).collect()}
    assert got["a"]["p_adjusted"] < 0.02 < 0.05 < got["b"]["p_adjusted"] and got["a"]["p_raw"] <= got["a"]["p_adjusted"]


def test_html_and_chunks():
    page = "<html><head><title>no</title></head><body><p>A  b<br>c</p><div style='display: none'>hidden</div><table><tr><td>1</td><td> 2 </td></tr><tr><th>h</th></tr></table>tail &amp; x</body></html>"
    assert text.html_text(page) == "A b\nc\n\n1 | 2\nh\n\ntail & x"
    assert text.html_text(None) is None and text.html_text("") == ""
    with pytest.raises(ValueError, match="script"):
        text.html_text("<p>a</p><script>b")
    body = "Intro\n\nPART I\n\nITEM 1. Business\n" + "word " * 30 + "\n\n" + "x" * 95 + "\n\nITEM 2\nend"
    cut = text.chunks_of(body, "10-K/A", 60)
    assert [c[0] for c in cut] == list(range(len(cut))) and all(0 < c[3] - c[2] <= 60 for c in cut)
    assert {c[1] for c in cut} == {"Cover", "Part I", "Part I > Item 1", "Part I > Item 2"}
    assert "".join("".join(body[a:z] for _, _, a, z in cut).split()) == "".join(body.split())
    assert {c[1] for c in text.chunks_of(body, "8-K", 60)} == {"8-K"} and text.chunks_of(None, "8-K") == []


def test_amounts_keep_their_currency():
    fault = lambda claim, chunk, quote=None: text.citation_fault(claim, quote or chunk, chunk, True, True)
    both = "Total revenue was RMB 12.3 billion (US$ 1.7 billion) in the quarter"
    assert fault("Revenue was US$ 12.3 billion", both) == "number_not_in_quote"
    assert fault("Revenue was RMB 12.3 billion", both) is None and fault("Revenue was US$ 1.7 billion", both) is None
    assert fault("Revenue was 12.3 billion", both) is None
    dollars = "The loss came to 5 billion dollars, a record for us"
    assert fault("A loss of 5 billion dollars", dollars) is None and fault("A loss of 5 billion euros", dollars) == "number_not_in_quote"
    assert fault("Sales of NTD 5.0 billion", "We had sales of NTD 5 billion last year") is None
    assert fault("sales of 3 mm and mm", "we had sales of 3 mm and mm there") == "unchecked_number"
    assert fault("fifty basis points", "it rose by fifty basis points again") == "unchecked_number"
    assert fault("up 50 basis points", "margins were up 50 basis points again") is None
    assert fault("down 12%", "margins were down 12 percent in the year") is None and fault("rose 5%", "the price rose 5. Percent of it") == "number_not_in_quote"
    assert fault("a loss of (281)", "we made a loss of (281 | ) in that year") is None


def test_blocks_that_end_paragraphs():
    assert text.html_text("<div>a <form>b</form> c</div>") == "a b c" and text.html_text("<html>a<nav>b</nav></html>") == "ab"


def test_citation_checks():
    chunk = "We had total revenue of $26 billion, up 5 percent, this year (281 | ) and three sites"
    quote = "total revenue of $26 billion, up 5 percent"
    check = text.citation_fault
    assert check("Revenue rose 5% to $26.0 billion", quote, chunk, True, True) is None
    assert check("x", quote, chunk, False, True) == "not_visible" and check("x", quote, chunk, True, False) == "entity_mismatch"
    assert check("x", None, chunk, True, True) == "missing_quote" and check("x", "revenue", chunk, True, True) == "quote_too_short"
    assert check("x", "q" * 501, chunk, True, True) == "quote_too_long" and check("x", "total revenue of $2", chunk + " " * 9, True, True) == "quote_too_short"
    assert check("x", "otal revenue of $26 billion", chunk, True, True) == "quote_not_in_chunk"
    assert check("sales doubled", quote, chunk, True, True) == "unchecked_number" and check("Revenue 7", quote, chunk, True, True) == "number_not_in_quote"
    assert check("three sites", quote, chunk, True, True) == "number_not_in_quote"


def test_components_of_long_chains(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70) if i != 40]
    got = {r["node"]: r["component"] for r in identity.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert len(got) == 71 and all(c == ("n000" if n <= "n040" else "n041") for n, c in got.items())


def test_parsers_and_writes(spark, tmp_path):
    raw = spark.createDataFrame([("forward_split", json.dumps({"symbol": "A", "ex_date": "2020-01-02", "old_rate": 1, "new_rate": 4})), ("forward_split", "{"), ("cash_dividend", json.dumps({"symbol": "A", "ex_date": "2020-01-02", "rate": -1}))], "kind string, json string")
    got = tables.parse_actions(raw)
    assert [r["factor"] for r in got["splits"].collect()] == [4.0]
    assert sorted(r["reason"] for r in got["rejects"].collect())[0] == "bad_rate" and got["rejects"].count() == 2
    table = tables.parse_table(spark.createDataFrame([(json.dumps({"fields": ["b", "a"], "data": [["1", "2"]]}),)], "json string")).first()["row"]
    assert table == {"a": "2", "b": "1"}
    path = f"{tmp_path}/bars"
    rows = lambda x: spark.createDataFrame(x, "symbol string, close double, year long")
    tables.write_merged(rows([("A", 1.0, 2020), ("B", 2.0, 2021)]), path, ["symbol", "year"], ["year"])
    tables.write_merged(rows([("A", 9.0, 2020), ("C", 3.0, 2020)]), path, ["symbol", "year"], ["year"])
    spark.catalog.refreshByPath(path)
    assert sorted((r["symbol"], r["close"]) for r in spark.read.parquet(path).collect()) == [("A", 1.0), ("B", 2.0), ("C", 3.0)]
    tables.write_snapshot(rows([]), f"{tmp_path}/snap", "2020-01-01")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        tables.write_snapshot(rows([]), f"{tmp_path}/snap", "2020-01-01")
    with pytest.raises(ValueError, match="columns"):
        tables.read_strict(spark, path, rows([]).schema.add("more", "string"))
    assert tables.missing_partitions(tables.plan_partitions("2020-01-01", "2021-02-01", "AB"), spark.createDataFrame([(2020, "A", True), (2021, "B", False)], "year long, bucket string, complete boolean")) == [(2020, "B"), (2021, "A"), (2021, "B")]
    assert tables.request_key({"b": 1, "a": "é"}) == tables.request_key({"a": "é", "b": 1})


def test_two_legs_and_cancelled_entries():
    rules, again = simulation.LegRules(zone_atr=0.5, zone_cap_pct=10.0, hard_atr=1.5, observe_days=2, trail_atr=3.0, max_sessions=9, bps=0.0), simulation.ReentryRules(window=6)
    days = [D(2020, 1, i + 1) for i in range(12)]
    run = lambda bars: simulation.run_decision(days[: len(bars)], bars, 100.0, 2.0, 10, 60.0, rules, again)
    assert run([(104, 105, 103, 104), (98.5, 99, 98, 98)]) == ([], "entry_below_zone")
    # the first leg is stopped within the day, the close holds the zone; a bar that touches its top and closes above buys again
    legs, why = run([(104, 105, 103, 104), (102, 103, 96, 101.5), (101.5, 102, 100.5, 101.5), (102, 104, 101.2, 103), (97, 98, 96, 97)])
    assert why is None and [(x["leg"], x["reason"], x["shares"]) for x in legs] == [(1, "hard", 10), (2, "hard_gap", 2)]
    assert legs[0]["exit_price"] == 97.0 and legs[0]["pnl"] == -50.0 and legs[1]["entry_price"] == 101.5  # ordered on the bar of the stop
    # a close under the zone forbids a second leg
    legs, _ = run([(104, 105, 103, 104), (102, 103, 96, 98), (101.5, 102, 100.5, 101.5), (102, 104, 101, 103)])
    assert len(legs) == 1
    assert simulation.run_decision([], [], 100.0, 2.0, 10, 1.0, rules, again) == ([], "no_size")


def test_tranches_sell_once_for_each_flag():
    days, bars = [D(2020, 1, i + 1) for i in range(6)], [(10 + i, 11 + i, 9 + i, 10 + i) for i in range(6)]
    flags = [(False, False), (True, False), (True, False), (True, True), (True, True), (True, True)]
    sold = simulation.run_tranches(days, bars, flags, ("red", "down"), 7, 0.0)
    assert [(x["day"].day, x["reason"], x["shares"], x["price"]) for x in sold] == [(3, "red", 3, 12.0), (5, "down", 4, 14.0)]
    assert simulation.run_tranches(days, bars, [(True, True)] * 6, ("red", "down"), 1, 0.0)[0]["shares"] == 1


def test_groups_are_whole_whatever_the_batches(spark):
    from kairoframe.operators.grouped import grouped_rows

    rows = [(k, i, float(k * i)) for k in range(7) for i in range(1 + 3 * k)]
    df = spark.createDataFrame(rows, "k long, i long, x double").orderBy(F.desc("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = grouped_rows(df, "k", "i", lambda g: [(g["k"][0], len(g["i"]), g["i"] == sorted(g["i"]))], "k long, n long, ordered boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == [(k, 1 + 3 * k, True) for k in range(7)]
    assert grouped_rows(df.limit(0), "k", "i", lambda g: [(1, 1, True)], "k long, n long, ordered boolean").count() == 0


def test_rounding_of_large_values(spark):
    """Beyond the greatest long a floor of a double used to stay at 9223372036854.775."""
    xs = [1.2345675, -1.2345675, 0.0, 2.0600447145753476e16, -3e20, 1e300, float("inf"), 9.3e12, 4503599627.123456, None]
    got = [r["y"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", aggregates.tidy(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [1.234568, -1.234567, 0.0, 2.0600447145753476e16, -3e20, 1e300, float("inf"), 9.3e12, 4503599627.123456, None]
    assert np.isnan(spark.sql("select double('nan') as x").select(aggregates.tidy(F.col("x")).alias("y")).first()["y"])


def test_curve_of_many_splits(spark):
    days = [D(2020, 1, 1) + datetime.timedelta(i) for i in range(31)]
    bars = spark.createDataFrame([("a", d, 10.0, 10.0) for d in days], "symbol string, session_date date, open double, close double")
    splits = spark.createDataFrame([("a", d, 5.0) for d in days[1:]], "symbol string, ex_date date, factor double")
    none = spark.createDataFrame([], "symbol string, ex_date date, rate double")
    last = simulation.buy_and_hold(bars, splits, none).withColumn("equity", aggregates.tidy(F.col("equity"))).orderBy(F.desc("session_date")).first()
    assert last["equity"] == pytest.approx(5.0**30, rel=1e-12)


def _shared(groups, names) -> dict:
    """Brute force: how many groups each two names are both in."""
    out: dict = {}
    for members in groups:
        for a in members:
            for b in members:
                if names[a] < names[b]:
                    out[names[a], names[b]] = out.get((names[a], names[b]), 0) + 1
    return out


def test_counts_of_identical_rows(spark):
    """Nulls equal nothing, copies of a row count once, names stand in the order of their bytes, and both ends carry their columns."""
    r = np.random.default_rng(3)
    names = [f"{'aZé€'[i % 4]}{i}" for i in range(60)]
    groups = [set(r.choice(60, size=n, replace=False).tolist()) for n in [1, 2, 60, *r.integers(2, 12, 80)]]
    rows = [(names[m], g, g % 3) for g, members in enumerate(groups) for m in members]
    rows += [*rows[:200], *[(n, None, 1) for n in names], *[(n, 1, None) for n in names]]
    df = spark.createDataFrame(rows, "name string, day long, trades long")
    about = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, number long")
    got = joins.identical_counts(df, about, "name", ["day", "trades"]).collect()
    assert len({(x["first_name"], x["second_name"]) for x in got}) == len(got)
    assert {(x["first_name"], x["second_name"]): x["identical"] for x in got} == _shared(groups, names)
    assert all(names[x["first_number"]] == x["first_name"] and names[x["second_number"]] == x["second_name"] for x in got)


@pytest.mark.parametrize(("counted", "batch"), [(1, 1), (40, 7), (300, 64), (1 << 20, 1 << 16)])
@pytest.mark.parametrize("one", [True, False])
def test_tiles_are_whole_whatever_the_chunks(monkeypatch, counted, batch, one):
    """Chunks of one entity, of many in dense or sparse cells, and batches cut inside a chunk give the same counts."""
    monkeypatch.setattr(joins, "COUNTED", counted)
    monkeypatch.setattr(joins, "BATCH", batch)
    r = np.random.default_rng(counted)
    names = sorted(f"n{i}" for i in range(50)) if one else [f"n{(i * 37) % 100}" for i in range(100)]
    a = [r.choice(50, size=n, replace=False).tolist() for n in [50, 2, *r.integers(2, 5, 60)]]
    b = a if one else [r.choice(50, size=n, replace=False).tolist() for n in [50, 1, *r.integers(1, 5, 60)]]
    sides = [(k, i) for k in ((2,) if one else (2, 5)) for i in range(50)]
    rows = [{"_tile": 2 * joins.SIDES + (2 if one else 5), "_a": x, "_b": y} for x, y in zip(a, b, strict=True)]
    rows += [{"_tile": rows[0]["_tile"], "_side": k, "_at": i, "_about": {"name": names[n]}} for n, (k, i) in enumerate(sides)][::-1]
    kinds = [("_tile", pa.int32()), ("_a", pa.list_(pa.int32())), ("_b", pa.list_(pa.int32())), ("_side", pa.int32()), ("_at", pa.int32()), ("_about", pa.struct([("name", pa.string())]))]
    got = [x for made in joins._tile_counts(pa.Table.from_pylist(rows, pa.schema(kinds)), "name", ["name"]) for x in made.to_pylist()]
    want: dict = {}
    for x, y in zip(a, b, strict=True):
        for i in x:
            for j in y:
                if not one or names[i] < names[j]:
                    pair = tuple(sorted((names[i], names[j if one else j + 50])))
                    want[pair] = want.get(pair, 0) + 1
    assert len(got) == len(want) and {(x["first_name"], x["second_name"]): x["identical"] for x in got} == want


def test_pairs_of_identical_bars_do_not_move(spark):
    """Nothing is joined or exchanged once pairs are made, so audit_n3's disk grows with bars, not with pairs."""
    from kairoframe import catalog

    plan = catalog.QUERIES["audit_n3"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Exchange")]
    assert "FlatMapGroupsInArrow" in after and "Join" not in after and "Aggregate" not in after
