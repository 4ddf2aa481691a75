"""The command line over the smallest tables."""

import pytest

from kairoframe import catalog
from kairoframe.__main__ import main
from kairoframe.commands import COMMANDS
from kairoframe.reports import as_table

SF = "/root/testdata/sf0.001"


def test_commands_name_registered_queries(capsys):
    assert len(COMMANDS) == 30 and main(["list"]) == 0
    assert "market status" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["market", "nothing"])
    with pytest.raises(SystemExit):
        main(["query", "run", "nothing"])


def test_status_search_and_init(spark, capsys, tmp_path):
    assert main(["market", "status", "--tables", SF]) == 0 and main(["query", "run", "bars_status", "--tables", SF, "--out", f"{tmp_path}/q"]) == 0
    assert spark.read.parquet(f"{tmp_path}/q/bars_status").count() == catalog.QUERIES["bars_status"](spark, SF).count()
    assert main(["db", "init", "--out", f"{tmp_path}/db"]) == 0 and spark.read.parquet(f"{tmp_path}/db/strategy_versions").count() == 0
    assert main(["db", "init", "--out", f"{tmp_path}/db"]) == 0 and "all tables are there" in capsys.readouterr().out
    word = spark.read.parquet(f"{SF}/documents.parquet").first()["text"].split()[0]
    assert main(["evidence", "search", "--query", word, "--tables", SF, "--rows", "2"]) == 0 and "score" in capsys.readouterr().out
    assert main(["market", "backfill", "--tables", SF]) == 0


def test_files_in(spark, capsys, tmp_path):
    (tmp_path / "w.json").write_text('{"groups": [{"id": "g", "kind": "company", "added": "2020-01-01", "items": [{"ticker": "S2"}, {"ticker": "NONE"}]}]}')
    assert main(["entities", "sync", "--file", f"{tmp_path}/w.json", "--tables", SF, "--out", f"{tmp_path}/e"]) == 0
    assert {r["ticker"]: r["outcome"] for r in spark.read.parquet(f"{tmp_path}/e/entities").collect()} == {"S2": "entity", "NONE": "missing"}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.htm").write_text("<p>Item 1. Business</p><p>We sell cars.</p>")
    assert main(["docs", "sync", "--file", f"{tmp_path}/f", "--out", f"{tmp_path}/d"]) == 0
    assert [r["text"] for r in spark.read.parquet(f"{tmp_path}/d/chunks").collect()] == ["Item 1. Business\n\nWe sell cars."]
    (tmp_path / "a.json").write_text('{"kind": "forward_split", "json": "{\\"symbol\\": \\"A\\", \\"ex_date\\": \\"2020-01-02\\", \\"old_rate\\": \\"1\\", \\"new_rate\\": \\"2\\"}"}\n')
    assert main(["market", "actions", "--file", f"{tmp_path}/a.json", "--out", f"{tmp_path}/x"]) == 0 and spark.read.parquet(f"{tmp_path}/x/splits").first()["factor"] == 2.0


def test_tables_as_markdown(spark):
    df = spark.createDataFrame([(2, None), (1, "a|b")], "n int, s string")
    assert as_table(df, ["n"]) == "| n | s |\n| --- | --- |\n| 1 | a\\|b |\n| 2 | n/a |"
