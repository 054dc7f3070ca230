import os

import pytest

from glossweave import session


def test_steps_are_written_and_cleared(spark):
    df = session.materialise(spark.range(5))
    made = [p.removeprefix("file:") for p in session._steps]
    assert df.count() == 5 and all(os.path.isdir(p) for p in made)
    session.clear_steps(spark)
    assert not any(os.path.exists(p) for p in made)


def test_own_steps_are_deleted(spark):
    outer = session.materialise(spark.range(2))
    with session.own_steps(spark):
        inner = session.materialise(spark.range(3))
        path = session._steps[-1].removeprefix("file:")
        assert inner.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path) and outer.count() == 2
    session.clear_steps(spark)


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(RuntimeError):
        session.shared_folder(Session)


def test_broadcast_only_behind_a_check(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(session.small_enough(spark.range(3), 3)) and "broadcast" not in plan(session.small_enough(spark.range(4), 3))
