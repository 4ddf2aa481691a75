"""Command line: `python -m kairoframe list`, `... query run|explain NAME`, or `... GROUP COMMAND` (commands.py).

Results are written as Parquet and Markdown to a folder (--out) or shown.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from . import catalog
from .commands import COMMANDS
from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kairoframe")
    p.add_argument("group", choices=("list", "query", *dict.fromkeys(g for g, _ in COMMANDS)))
    p.add_argument("command", nargs="?")
    p.add_argument("name", nargs="?", help="a query, for query run and query explain")
    p.add_argument("--tables", default=".", help="folder of the Parquet tables")
    p.add_argument("--master", default=None)
    p.add_argument("--out", default=None, help="folder to write to")
    p.add_argument("--file", default=None, help="input of entities sync, market actions and docs sync")
    p.add_argument("--form", default="10-K", help="form of the filings of docs sync")
    p.add_argument("--query", default=None, help="words of evidence search")
    p.add_argument("--entity", type=int, default=None, help="entity of evidence search")
    p.add_argument("--only", default=None, help="checks of market audit, comma-joined")
    p.add_argument("--alpha", type=float, default=0.05)
    p.add_argument("--budget", type=int, default=20)
    p.add_argument("--rows", type=int, default=20)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.group == "list":
        for name in sorted(catalog.QUERIES):
            print(name, "" if name in catalog.ORACLES else "(no twin)")
        for group, command in COMMANDS:
            print(group, command)
        return 0
    if a.group == "query":
        if a.command not in ("run", "explain") or a.name not in catalog.QUERIES:
            p.error(f"no query {a.name!r}, or neither run nor explain")
        df = catalog.QUERIES[a.name](session(a.master), a.tables)
        made = {a.name: df}
        if a.command == "explain":
            df.explain("formatted")
            return 0
    elif (a.group, a.command) not in COMMANDS:
        p.error(f"{a.group} has {', '.join(c for g, c in COMMANDS if g == a.group)}")
    else:
        made = COMMANDS[a.group, a.command](session(a.master), a)
    for name, result in made.items():
        if isinstance(result, str):
            print(result)
            if a.out and name == "report":
                Path(a.out).mkdir(parents=True, exist_ok=True)
                Path(a.out, f"{a.group}.md").write_text(result)
        elif a.out:
            result.write.parquet(f"{a.out}/{name}")
        else:
            print(name)
            result.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
