"""The account replay on hand-worked cases, and its stream."""

import datetime

import pytest

from kairoframe.operators import replay

DAYS = [datetime.date(2020, 1, 1) + datetime.timedelta(k) for k in range(40)]
RULES = replay.AccountRules(equity=10_000.0, risk_pct=1.0, atr_mult=2.0, position_pct=50.0, gross_pct=100.0, bps=0.0)


def session(k):
    return {"kind": "session", "security_id": None}


def bar(sid, o, high=None, low=None, close=None, flags=(), ratio=None, symbol=None):
    close = o if close is None else close
    return {"kind": "bar", "security_id": sid, "symbol": symbol or sid, "open": float(o), "high": float(high or max(o, close)), "low": float(low or min(o, close)), "close": float(close), "flags": list(flags), "ratio": ratio}


def signal(sid, close, atr=1.0, rank=1):
    return {"kind": "signal", "security_id": sid, "symbol": sid, "close": float(close), "atr": atr, "rank": rank}


def event(sid, ex, status, factor=None, known=None, children=(), first=0):
    return {"kind": "event", "security_id": sid, "ex_date": DAYS[ex], "first_day": DAYS[first], "status": status, "factor": factor, "known_on": None if known is None else DAYS[known], "children": list(children)}


def run(days, rules=RULES):
    """days: rows of each day -> (sales, cancelled, marks)."""
    account, out = replay.Account(rules), []
    for k, rows in enumerate(days):
        out += account.day(DAYS[k], [session(k), *rows])
    return tuple([r for r in out if r["kind"] == kind] for kind in ("sale", "cancelled", "mark"))


def test_two_tranches_and_marks():
    """50 shares (1 % of 10,000 over 2): bought at 102, half out at each exit's next open."""
    sales, gone, marks = run([
        [bar("A", 100), signal("A", 100)],
        [bar("A", 102, 106, 101, 105)],
        [bar("A", 105, 108, 95, 104, ["daily_red"])],
        [bar("A", 103, 120, 80, 103, ["daily_red", "weekly_down"])],
        [bar("A", 99, 130, 70, 99)],
        [bar("A", 500)],
    ])
    assert [(s["shares"], s["exit_price"], s["reason"], s["pnl"]) for s in sales] == [(25, 103.0, "daily_red", 25.0), (25, 99.0, "weekly_down", -75.0)]
    assert sales[0]["r_multiple"] == 0.5 and sales[1]["r_multiple"] == -1.5 and [s["held"] for s in sales] == [3, 4]
    assert sales[0]["mae_pct"] == pytest.approx(100 * (95 / 102 - 1)) and sales[1]["mfe_pct"] == pytest.approx(100 * (120 / 102 - 1))
    assert [m["equity"] for m in marks] == [10_000, 10_150, 10_100, 10_050, 9_950, 9_950] and not gone
    assert [m["gross"] for m in marks] == [0, 50 * 105, 50 * 104, 25 * 103, 0, 0]


def test_split_changes_units_only():
    one = run([[bar("A", 100), signal("A", 100)], [bar("A", 100, 104, 98, 102)], [bar("A", 102, 103, 90, 100, ["daily_red", "weekly_down"])], [bar("A", 101)]])[0]
    two = run([[bar("A", 100), signal("A", 100)], [bar("A", 100, 104, 98, 102)], [bar("A", 51, 51.5, 45, 50, ["daily_red", "weekly_down"], 2.0)], [bar("A", 50.5)]])[0]
    assert [(s["shares"], s["pnl"], s["r_multiple"]) for s in one] == [(25, 25, 0.5)] * 2
    assert [(s["shares"], s["pnl"], s["r_multiple"]) for s in two] == [(50, 25, 0.5)] * 2
    assert [s["mae_pct"] for s in one] == pytest.approx([s["mae_pct"] for s in two]) and one[0]["mfe_pct"] == pytest.approx(two[0]["mfe_pct"])
    gone = run([[bar("A", 100), signal("A", 100)], [bar("A", 10_000, ratio=0.01)]])[1]
    assert [g["reason"] for g in gone] == ["no_size"]


def test_missing_bars_and_jumps():
    sales, gone, _ = run([[bar("A", 100), signal("A", 100)], [bar("A", 100, close=101)], *[[]] * 5, [bar("A", 300)]])
    assert [(s["reason"], s["exit_price"], s["shares"], s["exit_day"]) for s in sales] == [("data_gap", 101.0, 50, DAYS[6])] and not gone
    assert [g["reason"] for g in run([[bar("A", 100), signal("A", 100)], []])[1]] == ["no_bar"]
    sales = run([[bar("A", 100), signal("A", 100)], [bar("A", 100, close=101)], [bar("A", 190)]])[0]
    assert [(s["reason"], s["exit_price"]) for s in sales] == [("price_jump", 101.0)]
    assert [g["reason"] for g in run([[bar("A", 100), signal("A", 100)], [bar("A", 190)]])[1]] == ["price_jump"]


def test_room_of_the_account():
    """B would need 50 shares of 100 beside A's 5,000: the cap of 100 % leaves room for 50; C finds none, and the night stops."""
    _, _, marks = run([[bar("A", 100), bar("B", 100), bar("C", 100), signal("A", 100, 1.0, 1), signal("B", 100, 1.0, 2), signal("C", 100, 1.0, 3)], [bar("A", 100), bar("B", 100), bar("C", 100)]])
    assert (marks[1]["gross"], marks[1]["positions"]) == (10_000, 2)
    _, _, marks = run([[bar("A", 9e6), bar("B", 100), signal("A", 9e6, 1.0, 1), signal("B", 100, None, 2), signal("A2", 100, 1.0, 3)], [bar("A2", 100)]])
    assert marks[1]["positions"] == 1


def test_spinoff_pays_children():
    """50 shares held at the ex-date are owed 0.1 of CH each, sold at its first open after the day the factor is known."""
    days = [
        [bar("A", 100), signal("A", 100), event("A", 2, "adjust", 0.8, 3, [("CH", 0.1)])],
        [bar("A", 100, 110, 90, 100)],
        [bar("A", 80, 84, 76, 80, ["daily_red"]), bar(None, 190, close=200, symbol="CH")],  # frozen: no exit is read
        [bar("A", 80, 80, 80, 80, ["daily_red"]), bar(None, 205, close=210, symbol="CH")],  # still frozen at the bar, known in the evening
        [bar("A", 81, 81, 81, 81, ["daily_red", "weekly_down"]), bar(None, 220, close=230, symbol="CH")],  # the children bring 50 * 0.1 * 220
        [bar("A", 82)],
    ]
    sales, _, marks = run(days)
    assert [(s["shares"], s["exit_price"], s["child_proceeds"], s["spinoff"]) for s in sales] == [(25, 82.0, 550.0, "adjust")] * 2
    assert [s["pnl"] for s in sales] == [25 * (82 - 100) + 550] * 2 and sales[0]["r_multiple"] == pytest.approx((82 - 100 + 22) / 2)
    assert sales[0]["mfe_pct"] == pytest.approx(10) and sales[0]["mae_pct"] == pytest.approx(-10)  # 110 / 100; 90 / 100 before, 76 / 80 after
    assert marks[4]["equity"] == 10_000 + 50 * (81 - 100) + 1100


def test_sale_before_the_children_is_held_back():
    days = [
        [bar("A", 100), signal("A", 100), event("A", 3, "adjust", 0.5, 4, [("CH", 1.0)])],
        [bar("A", 100)],
        [bar("A", 100, close=100, flags=["daily_red"])],
        [bar("A", 50), bar(None, 49, symbol="CH")],  # the ex-date: half is sold at the open, and held back
        [bar("A", 51), bar(None, 48, symbol="CH")],
        [bar("A", 52), bar(None, 47, symbol="CH")],
    ]
    sales, _, marks = run(days)
    assert [(s["shares"], s["exit_price"], s["exit_day"], s["day"], s["pnl"]) for s in sales] == [(25, 50.0, DAYS[3], DAYS[5], 25 * (50 - 100) + 25 * 47)]
    assert marks[3]["equity"] == 10_000 + 25 * (50 - 100) * 2 and marks[5]["equity"] == pytest.approx(10_000 + sales[0]["pnl"] + 25 * (52 - 100) + 25 * 47)


def test_spinoff_that_cannot_be_priced():
    head = [[bar("A", 100), signal("A", 100)], [bar("A", 100)]]
    never = [[event("A", 2, "pending"), bar("A", 80)], *[[bar("A", 80)]] * 5, [bar("A", 80, flags=["daily_red", "weekly_down"])], [bar("A", 90)]]
    sales = run(head + never)[0]
    assert [(s["spinoff"], s["child_proceeds"], s["mae_pct"]) for s in sales] == [("restart", 0.0, pytest.approx(-20))] * 2
    gone = run([[bar("A", 100), signal("A", 100), event("A", 1, "adjust", 0.9, 1, [("CH", 1.0)])], [bar("A", 90)]])[1]
    assert [g["reason"] for g in gone] == ["spinoff_ex"]
    absent = [[event("A", 2, "adjust", 0.5, 2, [("CH", 1.0)]), bar("A", 50), bar(None, 49, close=48, symbol="CH")], *[[bar("A", 50)]] * 5, [bar("A", 50, flags=["daily_red", "weekly_down"])], [bar("A", 60)]]
    assert [s["child_proceeds"] for s in run(head + absent)[0]] == [25 * 48.0] * 2  # its last close
    unseen = [[event("A", 2, "adjust", 0.5, 2, [("CH", 1.0)]), bar("A", 50)], *[[bar("A", 50)]] * 5, [bar("A", 50, flags=["daily_red", "weekly_down"])], [bar("A", 60)]]
    assert [(s["child_proceeds"], s["spinoff"]) for s in run(head + unseen)[0]] == [(0.0, "restart")] * 2


def test_stream_and_runs(spark):
    """Two runs over the same bars: rows come in order, a split between two bars is on the later one, a late record counts from the next day."""
    D = lambda k: DAYS[k]
    bars = spark.createDataFrame([("X", "S", D(k), 100.0, 101.0, 99.0, 100.0) for k in (0, 1, 2)] + [("X", "S", D(k), 50.0, 51.0, 49.0, 50.0) for k in (5, 6, 7)] + [("X", "T", D(8), 25.0, 25.0, 25.0, 25.0)], "security_id string, symbol string, session_date date, open double, high double, low double, close double")
    splits = spark.createDataFrame([("S", D(4), 2.0), ("S", D(8), 2.0)], "symbol string, ex_date date, factor double")
    events = spark.createDataFrame([("X", D(6), datetime.datetime(2020, 1, 7, 14, 31), "pending", None, None, [])], f"security_id string, ex_date date, first_known timestamp_ntz, status string, factor double, known_on date, children {replay.CHILDREN}")
    flags = spark.createDataFrame([("X", D(6), ["daily_red", "weekly_down"])], "security_id string, session_date date, flags array<string>")
    signals = spark.createDataFrame([(r, D(0), "X", "S", 100.0, 1.0, 1) for r in (1, 2)], "run_id long, session_date date, security_id string, symbol string, close double, atr double, rank int")
    runs = spark.createDataFrame([(1, D(0), D(9)), (2, D(0), D(6))], "run_id long, first date, last date")
    rows = replay.stream(runs, bars.select("session_date").distinct(), signals, bars, splits, events, flags)
    got = {(r["run_id"], r["day"]): r["ratio"] for r in rows.filter("kind = 'bar'").collect()}
    assert got[(1, D(5))] == 2.0 and got[(1, D(8))] == 2.0 and got[(1, D(6))] is None and (2, D(7)) not in got
    assert rows.filter("kind = 'event'").first()["first_day"] == datetime.date(2020, 1, 8)
    out = replay.replayed(rows, RULES).collect()
    sales = sorted((r["run_id"], r["day"], r["shares"], r["exit_price"], r["pnl"]) for r in out if r["kind"] == "sale")
    assert sales == [(1, D(7), 50, 50.0, 0.0), (1, D(7), 50, 50.0, 0.0)]
    marks = {r["run_id"]: r["equity"] for r in sorted(out, key=lambda r: r["day"]) if r["kind"] == "mark"}
    assert marks == {1: 10_000.0, 2: 10_000.0}
