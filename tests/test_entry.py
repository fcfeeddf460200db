"""The driver contract, and jobs that start from another folder."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

AWAY = f"""
import sys
sys.path.insert(0, {ROOT!r})
from brimwatch.operators.retrieve import cosine_top_k
from brimwatch.session import local_session

spark = local_session(2, memory="1g")
rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, embedding array<double>")
best = cosine_top_k(rows.selectExpr("id AS query_id", "embedding"), rows.selectExpr("id AS doc_id", "embedding"), 1)
print("found", sorted((r.query_id, r.doc_id) for r in best.collect()))
"""

WITHOUT = f"""
import sys
sys.path.insert(0, {ROOT!r})
sys.modules["brimwatch.llm.queries"] = None
import __spark_entry__ as entry
print("names", len(entry.queries()), any(n.startswith("op") or n == "pipeline" for n in entry.queries()))
"""


def run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_workers_find_the_package_from_another_folder(tmp_path):
    assert f"found {[(i, i) for i in range(6)]}" in run(AWAY, tmp_path)


def test_entry_without_the_optional_operators(tmp_path):
    names = run(WITHOUT, tmp_path).split("names ")[1].split()
    assert int(names[0]) >= 94 and names[1] == "False"
