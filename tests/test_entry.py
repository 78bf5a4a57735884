import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "framelake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "framelake.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


def test_a_missing_library_leaves_the_rest(monkeypatch):
    monkeypatch.setitem(sys.modules, "framelake.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.warns(UserWarning, match="left out"):
        known = entry.queries()
    assert "cosine_topk" in known and not [n for n in known if n.startswith("op") or n == "pipeline"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    stated = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert stated and entry.entry(spark).count() == 10 * stated
