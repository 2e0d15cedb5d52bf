"""Tables of the shared folder: who deletes which, and when."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest

from agora.llm import queries, runtime


def there(df):
    return Path(df.agora_path.removeprefix("file:")).exists()


def test_a_scratch_deletes_its_own_tables_alone(spark):
    made, others, go, done = {}, {}, threading.Event(), threading.Event()

    def other():
        with runtime.scratch(spark):
            others["a"] = runtime.table(spark.range(3), "other")
            go.set()
            done.wait(60)
            others["kept"] = there(others["a"])

    thread = threading.Thread(target=other)
    thread.start()
    assert go.wait(60)
    with runtime.scratch(spark):
        made["a"] = runtime.table(spark.range(3), "own")
        with runtime.scratch(spark):
            made["b"] = runtime.table(spark.range(3), "inner")
        assert there(made["a"]) and not there(made["b"])
    done.set()
    thread.join()
    assert others["kept"] and not there(others["a"]) and not there(made["a"])


def test_a_failed_stage_leaves_nothing(spark):
    made = []
    with pytest.raises(ZeroDivisionError), runtime.scratch(spark):
        made.append(runtime.table(spark.range(3), "lost"))
        raise ZeroDivisionError
    assert not there(made[0]) and runtime._open.get() == ()

    def query(spark, sf_dir):
        made.append(runtime.table(spark.range(3), "lost"))
        if sf_dir == "bad":
            raise ZeroDivisionError
        return made[-1]

    with pytest.raises(ZeroDivisionError):
        queries.guarded(query)(spark, "bad")
    assert not there(made[1])
    assert queries.guarded(query)(spark, "good").count() == 3 and there(made[2])
    runtime.release(made[2])
    assert not there(made[2])
