"""The corpus operators are optional: nothing else needs them."""

import shutil
import subprocess
import sys
from pathlib import Path

from conftest import SMALL

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "stratalode", tmp_path / "stratalode", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_the_rest_runs_without_the_corpus_operators(tmp_path):
    """All queries of the catalogue, in a process that has neither folder."""
    shutil.copytree(ROOT / "stratalode", tmp_path / "stratalode", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[4]').config('spark.sql.shuffle.partitions', '4').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {str(tmp_path / "shared")!r}).getOrCreate()
for name, run in e.queries().items():
    run(spark, {SMALL!r}).write.format('noop').mode('overwrite').save()
print(len(e.queries()), 'ran')
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, capture_output=True, text=True, timeout=1500)
    assert done.stdout.endswith(" ran\n") and int(done.stdout.split()[-2]) > 100


def test_nothing_imports_them():
    for path in (ROOT / "stratalode").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert ".llm" not in path.read_text()
