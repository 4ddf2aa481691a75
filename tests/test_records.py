"""Filings, governance, exports and edge rules on hand-made cases."""

import datetime

import pytest

from kairoframe.operators import edge_rules, exports, filings, governance, identity

D = datetime.date


def test_filing_index():
    page = "<table><tr><th>Seq</th></tr><tr><td>1</td><td>FORM 8-K</td><td><a href='x'>a.htm</a> iXBRL</td><td>8-K</td><td>9</td></tr><tr><td> </td><td>Full &amp; text</td><td>b.txt</td><td></td></tr><tr><td>2</td></tr></table>"
    assert filings.index_entries(page) == [(1, "FORM 8-K", "a.htm", "8-K"), (None, "Full & text", "b.txt", "")]
    assert filings.index_entries(None) == [] and filings.lookback_sessions(14, 20, 5) == 21


def test_parsed_index(spark):
    page = "<table><tr><td>1</td><td>d</td><td>a.htm</td><td>EX-99.1</td></tr></table>"
    rows = filings.parsed_index(spark.createDataFrame([("A", page), ("B", None)], "accn string, html string"), "accn", "html").collect()
    assert [tuple(r) for r in rows] == [("A", 1, "d", "a.htm", "EX-99.1")]


def test_overrides_and_hashes(spark):
    config = {"scan": {"atr": 14, "gap": 0.04, "kinds": ["a", "b"]}, "judge": {"kind": "take_all"}}
    assert governance.canonical_overrides(config, ["scan.gap=1", "scan.atr=3"]) == governance.canonical_overrides(config, ["scan.atr=3", "scan.gap=1.0"]) == [("scan.atr", 3), ("scan.gap", 1.0)]
    for bad in ("scan.none=1", "none.atr=1", "atr=1", "scan.atr"):
        with pytest.raises(ValueError):
            governance.overridden(config, [bad])
    pairs = [("a.x", None), ("a.y", {"k": None, "m": "not None"}), ("b.z", [1, 2])]
    assert governance.overrides_of_summary(governance.summary_of(pairs)) == ["a.x=null", "a.y={'k': null, 'm': 'not None'}", "b.z=[1, 2]"]
    files = {"base": b"x: 1", "scan": b"y: 2"}
    one = governance.strategy_hash(files)
    assert one != governance.strategy_hash(files, [("scan.atr", 3)])
    rows = spark.createDataFrame([("s", k, v) for k, v in files.items()], "strategy_id string, name string, body binary")
    assert governance.strategy_hashes(rows).first()["content_hash"] == one


def test_versions_are_registered_once(spark):
    now, none = datetime.datetime(2020, 1, 1), spark.createDataFrame([], governance.VERSIONS)
    first = governance.registered(none, "s", "base", "child", "scan.atr=3", "human", now)
    rows = {r["content_hash"]: r for r in first.collect()}
    assert rows["base"]["status"] == "approved" and rows["base"]["change_kind"] == "new_strategy"
    assert rows["child"]["status"] == "proposed" and rows["child"]["parent_hash"] == "base" and rows["child"]["summary"] == "scan.atr=3"
    assert governance.registered(first, "s", "base", "child", "scan.atr=3", "human", now).count() == 2
    later = {r["content_hash"]: r for r in governance.registered(first, "s", "edited", "edited", None, "human", now).collect()}
    assert later["edited"]["status"] == "proposed" and later["edited"]["parent_hash"] == "base"


PROTOCOL = """{"dev": {"start": "2020-01-02", "end": "2023-12-29"}, "holdout": {"start": "2024-01-02", "end": "2024-12-31"}, "clean_after": "2025-01-01", "seen_before_protocol": ["x"],
"attempt_budget": 20, "alpha": 0.05, "permutations": 1000, "thin_edge": {"drop_top": 3, "extra_cost_bps": 5}, "benchmarks": {"symbols": ["SPY"]}, "comparison": {"risk_free_rate": 0.03},
"walk_forward": {"train_months": 12, "test_months": 3, "min_positive": 2}, "mde_power": 0.8}"""


def test_protocol_and_holdout(spark):
    p = governance.load_protocol(PROTOCOL)
    assert p.from_date(D(2021, 1, 4)).dev == governance.Window(D(2021, 1, 4), D(2023, 12, 29))
    for old, new in (('"alpha": 0.05', '"alpha": 1.5'), ('"2023-12-29"', '"2024-03-01"'), ('"mde_power": 0.8', '"other": 1'), ('"permutations": 1000', '"permutations": 5')):
        with pytest.raises((ValueError, TypeError)):
            governance.load_protocol(PROTOCOL.replace(old, new))
    with pytest.raises(ValueError):
        p.from_date(D(2024, 5, 1))
    none = spark.createDataFrame([], governance.OPENINGS)
    assert not governance.may_open(none, p, "s", D(2020, 1, 2), D(2020, 5, 1), False)
    with pytest.raises(PermissionError):
        governance.may_open(none, p, "s", D(2024, 1, 2), D(2024, 5, 1), False)
    assert governance.may_open(none, p, "s", D(2024, 1, 2), D(2024, 5, 1), True)
    once = governance.with_opening(none, "s", "hash", 7, p.holdout, datetime.datetime(2025, 1, 1))
    with pytest.raises(PermissionError):
        governance.may_open(once, p, "s", D(2024, 1, 2), D(2024, 5, 1), True)


def test_watchlist(spark):
    text = '{"groups": [{"id": "g", "kind": "company", "added": "2020-01-01", "items": [{"ticker": "aaa"}, {"ticker": "BBB", "cik": 9}, {"ticker": "CCC"}, {"ticker": "FND", "kind": "fund"}, {"ticker": "TWO", "kind": "fund"}, {"ticker": "TWO2", "kind": "fund", "cik": 5}, {"ticker": "NOF", "kind": "fund", "note": "gold"}, {"ticker": "BTC", "kind": "crypto", "name": "Bitcoin"}]}]}'
    items = spark.createDataFrame(governance.load_watchlist(text), governance.WATCHLIST)
    companies = spark.createDataFrame([("AAA", 1, "A Co"), ("BBB", 2, "B Co")], "ticker string, cik long, name string")
    funds = spark.createDataFrame([("FND", 3, "S1", "Fund"), ("TWO", 4, "S2", None), ("TWO", 6, "S3", None), ("TWO2", 6, "S3", None), ("BTC", 8, "S8", "Coin fund")], "ticker string, cik long, series_id string, name string")
    got = {r["ticker"]: (r["outcome"], r["cik"], r["name"]) for r in governance.resolved_watchlist(items, companies, funds).collect()}
    assert got == {"AAA": ("entity", 1, "A Co"), "BBB": ("conflict", None, "B Co"), "CCC": ("missing", None, "CCC"), "FND": ("entity", 3, "Fund"), "TWO": ("conflict", None, "TWO"), "TWO2": ("conflict", None, "TWO2"), "NOF": ("unmatched", None, "gold"), "BTC": ("entity", None, "Bitcoin")}
    for bad in ('{"groups": []}', text.replace('"aaa"', "null"), text.replace("CCC", "AAA"), text.replace('"kind": "crypto"', '"kind": "coin"')):
        with pytest.raises(ValueError):
            governance.load_watchlist(bad)


def test_exceptions_instants_and_parallel_map(spark):
    entry = '[{"key": "AAA:periodic-gap:2020-01-01", "reason": "late", "added": "2020-05-05", "by": "me"}]'
    assert governance.load_exceptions(entry) == {"AAA:periodic-gap:2020-01-01": "late"} and governance.load_exceptions("") == {}
    for bad in (entry.replace("late", " "), entry.replace("periodic-gap", "gap"), entry.replace('"by"', '"who"')):
        with pytest.raises(ValueError):
            governance.load_exceptions(bad)
    got = governance.load_instants("# two\n2020-01-02T00:00:00+01:00\n2019-01-01T00:00:00+00:00\n")
    assert [t.isoformat() for t in got] == ["2019-01-01T00:00:00+00:00", "2020-01-01T23:00:00+00:00"]
    with pytest.raises(ValueError):
        governance.load_instants("2020-01-02T00:00:00")
    assert governance.parallel_map(spark, lambda c, u: c * u, 3, [5, 1, 4]) == [15, 3, 12] and governance.parallel_map(spark, max, 1, []) == []


def test_quote_spans_and_request():
    assert exports.span_of("a b\n c", "b c") == (2, 6) and exports.span_of("abc", "bc") == (1, 3) and exports.span_of("abc", " ") is None and exports.span_of("abc", "x y") is None
    body = exports.request_body("m", [{"role": "user", "content": "q"}], {"type": "object"}, "low", "one", 100)
    assert body["provider"]["allow_fallbacks"] is False and body["response_format"]["json_schema"]["strict"] is True


def test_run_export_and_cited_chunks(spark):
    curve = spark.createDataFrame([(1, D(2020, 1, 3), 2.0), (1, D(2020, 1, 2), 1.0)], "run_id int, session_date date, equity double")
    made = exports.run_export(spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, name string"), curve, spark.createDataFrame([(1, 0.5)], "run_id int, sharpe double"))
    got = {r["run_id"]: r for r in made.collect()}
    assert [p["equity"] for p in got[1]["curve"]] == [1.0, 2.0] and got[2]["curve"] is None and got[1]["sharpe"] == 0.5
    chunks = spark.createDataFrame([(1, 7, "Item 1", "we sold\nmore cars"), (2, 7, "Item 2", "x")], "chunk_id int, document_id int, section_path string, text string")
    quotes = spark.createDataFrame([(1, "sold more"), (1, "cars"), (1, "cars"), (1, "absent words")], "chunk_id int, quote string")
    row = exports.cited_chunks(chunks, quotes).collect()
    assert len(row) == 1 and [tuple(s) for s in row[0]["spans"]] == [(3, 12), (13, 17)]


def test_reachable_without_a_node(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("D", "A"), ("X", "Y")], "old string, new string")
    starts = spark.createDataFrame([("A", "B"), ("C", "D"), ("X", "Y")], "start string, without string")
    got = {}
    for r in identity.reachable_without(edges, starts).collect():
        got.setdefault((r["start"], r["without"]), set()).add(r["symbol"])
    assert got == {("A", "B"): {"A", "C", "D"}, ("C", "D"): {"A", "B", "C"}, ("X", "Y"): {"X"}}
    trips = identity.round_trips(spark.createDataFrame([("O", "1O", 1), ("1O", "O", 5), ("P", "Q", 2)], "old string, new string, day int")).collect()
    assert [tuple(r) for r in trips] == [("O", "1O", 1, 5)]


def bars(spark, rows):
    """rows: symbol, first day, last day, seed; a price a day from the seed, so that equal seeds are copies."""
    out = []
    for symbol, a, z, seed in rows:
        for k in range(a, z + 1):
            day = D(2020, 1, 1) + datetime.timedelta(k)
            p = 10 + (k * 37 + seed * 101) % 53
            out.append((symbol, day, p + 0.5, p + 2.0, p - 1.0, p + 1.0, 100, datetime.datetime(day.year, day.month, day.day, 20)))
    return spark.createDataFrame(out, "symbol string, session_date date, open double, high double, low double, close double, volume long, available_at timestamp_ntz")


def test_rename_that_nobody_filed(spark):
    """OLD's bars are NEW's for ten days and stop, NEW goes on; a stranger with bars of its own before is none."""
    rows = [("OLD", 0, 39, 1), ("OLD", 40, 49, 2), ("NEW", 40, 90, 2), ("BUSY", 0, 59, 5), ("BUSY", 60, 90, 3), ("GONE", 60, 69, 3), ("ALL", 0, 90, 7)]
    edges = spark.createDataFrame([("ALL", "ZZZ", D(2020, 2, 1))], "old_symbol string, new_symbol string, date date")
    got = edge_rules.renames_from_bars(bars(spark, rows), edges).collect()
    assert [(r["old_symbol"], r["new_symbol"], r["date"]) for r in got] == [("OLD", "NEW", D(2020, 1, 1) + datetime.timedelta(50))]
    known = spark.createDataFrame([("NEW", "OLD", D(2020, 2, 1))], "old_symbol string, new_symbol string, date date")
    assert edge_rules.renames_from_bars(bars(spark, rows), known).count() == 0


def test_takeovers_are_settled(spark):
    b = bars(spark, [("LBL", 0, 30, 1), ("TK", 0, 30, 1), ("LB2", 0, 30, 2), ("TK2", 0, 30, 3), ("LB3", 0, 30, 4)])
    at = lambda k: D(2020, 1, 1) + datetime.timedelta(k)
    takeovers = spark.createDataFrame([(1, "LBL", at(0), at(31), 1, 10), (2, "LB2", at(0), at(31), 2, 20), (3, "LB3", at(0), at(31), 3, 3), (4, "LB3", at(5), at(31), 4, 30)], "key int, symbol string, valid_from date, cut date, chain int, taker int")
    members = spark.createDataFrame([(1, "TK", at(0), at(31)), (2, "TK2", at(0), None), (3, "TK", at(0), at(31))], "key int, member string, lo date, hi date")
    pieces = spark.createDataFrame([("LBL", 1, at(0), at(31)), ("LB2", 2, at(0), at(31)), ("LB3", 3, at(0), at(5)), ("LB3", 4, at(5), at(31))], "symbol string, chain int, valid_from date, valid_to date")
    got = {r["key"]: r["resolution"] for r in edge_rules.settled_takeovers(takeovers, members, pieces, b).collect()}
    assert got == {1: "relabelled", 2: "new_security", 3: "bridged", 4: "unresolved"}


def test_filings_in_windows_that_meet(spark):
    """Windows of an entity and a filer that meet are one, empty ones none; equal filings give a row for each entity."""
    day = lambda k: None if k is None else D(2020, 1, 1) + datetime.timedelta(k)
    spans = [("a", 1, None, None), ("a", 1, 3, 9), ("b", 1, 2, 6), ("b", 1, 4, 8), ("b", 1, 8, 9), ("b", 1, 12, 12), ("b", 1, 20, 15), ("c", 1, None, 5), ("c", 1, 4, 7), ("c", 1, 9, None), ("c", 1, 11, 13), ("b", 2, 5, None), ("d", 2, 5, 6)]
    windows = spark.createDataFrame([(e, c, day(a), day(z)) for e, c, a, z in spans], "entity_id string, cik int, start date, end date")
    made = sorted((r["entity_id"], r["cik"], r["start"], r["end"]) for r in filings.disjoint_windows(windows).filter("entity_id = 'b'").collect())
    assert made == [("b", 1, day(2), day(9)), ("b", 2, day(5), None)]
    rows = [(f"A{k}", c, day(k)) for k in range(25) for c in (1, 2)] * 2
    got = filings.belonging(spark.createDataFrame(rows, "accn string, cik int, filed date"), windows, "filed").collect()
    want = {(n, c, d, e) for n, c, d in rows for e, f, a, z in spans if f == c and (a is None or day(a) <= d) and (z is None or d < day(z))}
    assert len(got) == len(want) and {(r["accn"], r["cik"], r["filed"], r["entity_id"]) for r in got} == want


def test_latest_filers_of_one_large_filer(spark):
    """A filer with 60,000 filings and 20,000 securities: 1.2 billion pairs used to be made and sorted."""
    import time

    from kairoframe.operators import scans

    at = "timestamp_ntz'2020-01-01 00:00:00'"
    made = spark.range(60_000).selectExpr("1 as cik", "concat('A', id) as accn", f"{at} + make_dt_interval(0, 0, id % 50000) as available_at")
    segments = spark.range(20_000).selectExpr("concat('X', id) as security_id", "1 as cik", f"{at} as available_at", f"{at} as cik_available_at")
    start = time.time()
    got = scans.latest_filers(made, segments, "2020-12-31 00:00:00").groupBy("accn").count().collect()
    assert [tuple(r) for r in got] == [("A49999", 20_000)] and time.time() - start < 20


def test_filings_of_many_entities_are_written_small(spark, tmp_path):
    """1.8 million rows of 6,000 filings with 300 entities each, by filers that take turns: under half a byte a row. Nulls match open windows."""
    made = spark.range(6_000).selectExpr("concat('A', id * 7919) as accn", "cast(id % 20 as int) as cik", "date_add(date'2020-01-01', cast(id % 4 as int)) as filed")
    windows = spark.range(6_000).selectExpr("concat('X', id * 31) as entity_id", "cast(id % 20 as int) as cik", "cast(null as date) as start", "cast(null as date) as end")
    filings.belonging(made, windows, "filed").select("accn", "entity_id").write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert got.count() == got.distinct().count() == 1_800_000 and size < 900_000
    some = spark.createDataFrame([("A", 1, None), ("A", 1, None), ("B", None, D(2020, 1, 1)), (None, 1, D(2020, 1, 1))], "accn string, cik int, filed date")
    few = spark.createDataFrame([("a", 1, None, None), (None, 1, None, None), ("b", 1, D(2019, 1, 1), None), ("c", None, None, None)], "entity_id string, cik int, start date, end date")
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted((tuple(r) for r in filings.belonging(some, few, "filed").select("accn", "entity_id").collect()), key=key) == sorted([("A", "a"), ("A", None), (None, "a"), (None, None), (None, "b")], key=key)
    lone = filings.belonging(some.select("cik", "filed"), few, "filed")  # no other column
    assert lone.columns == ["cik", "filed", "entity_id"] and lone.count() == 5
