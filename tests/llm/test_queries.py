"""The registered queries: oracles, row counts, and the rules of this subpackage."""

import pathlib
import re
from collections import Counter

import pytest

from __spark_entry__ import oracle_sql, queries
from lamella.llm.registry import ORACLES, QUERIES
from tests.compare import diff, duck, rows_of_duck, rows_of_spark

FOLDER = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parent.parent.parent


def test_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    got = rows_of_spark(QUERIES[name](spark, FOLDER))
    assert diff(got, rows_of_duck(duck(FOLDER), ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("op7_packing", "op13_hard_negatives", "pipeline")))
def test_one_row_per_document(spark, name):
    ids = Counter(r.doc_id for r in QUERIES[name](spark, FOLDER).select("doc_id").collect())
    assert ids == Counter(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())


def test_nothing_outside_imports_this_subpackage():
    for path in [*(ROOT / "lamella").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert "lamella.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


def test_forbidden_calls():
    """Only bounded results reach the driver (toLocalIterator of models and counts)."""
    bad = r"\.collect\(\)|toPandas|localCheckpoint|crossJoin|\.rdd\b|F\.udf|applyInPandas\("
    for path in [*(ROOT / "lamella" / "llm").glob("*.py"), ROOT / "corpus_pipeline.py"]:
        assert re.findall(bad, path.read_text()) == []
