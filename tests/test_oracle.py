"""Every statement against its job, on the smallest test data."""
import math
import os
import subprocess
import sys

import duckdb
import pytest

from conftest import TESTDATA

sys.path.insert(0, ".")
import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_job_equals_statement(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(shown(row[i]) for i in at) for row in result.fetchall())
    ours = sorted(tuple(map(shown, row)) for row in df.select(*columns).collect())
    assert ours == theirs


def test_every_statement_has_a_job():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if not TESTDATA:
        pytest.skip("no test data")
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("missing", ["public_tokenizers", "storelens.llm", "corpus_pipeline"])
def test_store_jobs_stand_without_the_corpus_operators(missing):
    """A package that only the corpus operators need may be absent, and so may these themselves."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))")
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(entry.registry.jobs())), str(len(entry.statements.all_statements())), "False"]
    assert "without corpus operators" in done.stderr
