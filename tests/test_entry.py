import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_training_data_package(tmp_path):
    away = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=away)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'])"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, with_sql, own = said.stdout.strip().splitlines()[-1].split(" ", 2)
    assert int(n) > 100 and int(with_sql) > 100 and own == "[]"


@pytest.mark.parametrize("name", ["structure_counts", "quality_by_source", "missing_tables", "job_state"])
def test_results_do_not_depend_on_partitions(spark, name):
    import __spark_entry__ as entry

    query, before, out = entry.queries()[name], spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = query(spark, "/root/testdata/sf0.001").collect()
        out.append(sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]
