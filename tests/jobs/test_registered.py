"""The jobs' queries against their SQL, and what the jobs import."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import registered
from tests.plans.test_queries import duck, rows_of  # noqa: F401


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):  # noqa: F811
    before = dict(spark.conf.getAll)
    frame = registered.QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    cursor: duckdb.DuckDBPyConnection = duck.execute(registered.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert got == rows_of(columns, cursor.fetchall()) and got
    assert dict(spark.conf.getAll) == before


def test_command_line(tmp_path):
    root = Path(__file__).resolve().parents[2]
    paths = {"--input": "/root/testdata/sf0.001/orders.parquet", "--output": str(tmp_path / "out"), "--checkpoint": str(tmp_path / "mark")}
    done = subprocess.run([sys.executable, "-m", "jobs.monthly_panel", "--config", "jobs/monthly_panel.json", *[x for p in paths.items() for x in p]], cwd=root, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "new rows in 1 batches" in done.stderr and len(list((tmp_path / "out").glob("period=*"))) == 80


def test_jobs_do_without_the_training_data_operators():
    for path in (Path(registered.__file__).parent).glob("*.py"):
        text = path.read_text(encoding="utf-8")
        assert "llm" not in text and "corpus_pipeline" not in text
