import importlib
import sys
from types import SimpleNamespace

import pytest

from hirelake import session


def test_scratch_folder_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    scratch = session.Scratch(spark, "job")
    frame = spark.range(10).selectExpr("id", "id % 3 AS k")
    kept = scratch.table(frame, "rows")
    dealt = scratch.bucketed(frame, "dealt", 4, "k")
    assert kept.count() == dealt.count() == 10
    plan = dealt.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # rows of one key lie together already
    assert len(list(tmp_path.iterdir())) == 1
    scratch.drop()
    assert list(tmp_path.iterdir()) == []
    assert not spark.catalog.tableExists(scratch.names[0])


@pytest.mark.parametrize(("master", "allowed"), [("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False),
                                                 ("spark://host:7077", False)])
def test_only_a_local_session_has_a_folder_of_its_own(master, allowed):
    class Conf:
        def get(self, key, default):
            return default

    fake = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master))
    if allowed:
        assert session.shared_dir(fake) == session.LOCAL_FALLBACK
    else:
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.shared_dir(fake)


def test_entry_works_without_the_optional_part(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec",
                        lambda name, *a: None if name in ("hirelake.llm", "corpus_pipeline") else real(name, *a))
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(entry.oracle_sql())
    assert not any(name.startswith("op1_") or name == "pipeline" for name in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
