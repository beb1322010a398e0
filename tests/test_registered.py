"""Every registered query against its SQL twin on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as registered
import verify

HERE = str(Path(__file__).resolve().parents[1])
SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_result_as_sql(spark, con, name):
    assert verify.difference(QUERIES[name], SQL.get(name), spark, con, SF_DIR) == ""


def test_streamed_signed_levels_equal_batch(spark):
    row = QUERIES["t1_stream_cs"](spark, SF_DIR).first()
    assert row.cells > 0 and row.unequal == 0


@pytest.mark.parametrize("missing", ["public_tokenizers", "rillcount.llm", "corpus_pipeline", "xxhash_is_here"])
def test_entry_without_the_training_data_package(missing):
    """A missing package or library takes its own queries away and no others."""
    script = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as e
names = set(e.queries())
assert "k1_im_sum" in names and set(e.oracle_sql()) <= names
print(sum(n.startswith("op") for n in names))
"""
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=HERE)
    assert run.returncode == 0, run.stderr
    with_package = any(name.startswith("op") for name in QUERIES)
    assert (int(run.stdout) > 0) == (with_package and missing == "xxhash_is_here")


def test_entry(spark):
    df = registered.entry(spark)
    rows = df.collect()
    assert df.columns == ["item", "est", "total"]
    assert rows and all(r.est >= r.total for r in rows)
