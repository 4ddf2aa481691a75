import re
import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert {'pipeline', 'op6_secret_scan'} <= set(q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2])


def test_nothing_else_imports_the_folder():
    root = Path(__file__).resolve().parents[2]
    for path in root.rglob("*.py"):
        part = path.relative_to(root)
        if "llm" in part.parts or part.name in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(), re.M), part
