"""The entry points work without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

from quern.plans.checks import collect

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'v10_search_topk' in e.queries())"


def test_entry_points_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", SHOW], capture_output=True, text=True, cwd=tmp_path)
    n = len(collect())
    assert done.stdout.split() == [str(n), str(sum(c.sql is not None for c in collect().values())), "True"], done.stderr
