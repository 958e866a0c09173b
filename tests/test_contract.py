"""The library without its optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
    n, has_pipeline, fits = done.stdout.split()
    assert int(n) > 80 and has_pipeline == "False" and fits == "True"


def test_nothing_else_imports_the_optional_parts():
    for folder, _, names in os.walk(f"{ROOT}/gridloom"):
        if "/llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(f"{folder}/{n}") as f:
                        text = f.read()
                    assert "llm" not in text, f"{folder}/{n}"
