"""Tables that a call stores on the way: deleted after it, also when it fails, and never those of another thread."""

import threading
from pathlib import Path

import pytest

from voxdose.llm import common


def files(spark):
    return {p.name for p in Path(common.shared_dir(spark).removeprefix("file:")).glob("table-*")}


def test_only_the_result_stays(spark):
    before = files(spark)
    out = common.stored_alone(spark, lambda: common.stored(common.stored(spark.range(5)).where("id > 1")))
    assert len(files(spark) - before) == 1 and out.count() == 3


def test_failure_leaves_nothing(spark):
    before = files(spark)

    def fail():
        common.stored(spark.range(5))
        raise KeyError("no")

    with pytest.raises(KeyError):
        common.stored_alone(spark, fail)
    assert files(spark) == before


def test_other_threads_keep_theirs(spark):
    begun, end, kept = threading.Event(), threading.Event(), []

    def other():
        begun.wait()
        kept.append(common.stored(spark.range(7)))
        end.set()

    thread = threading.Thread(target=other)
    thread.start()

    def make():
        begun.set()
        end.wait()
        return common.stored(spark.range(3))

    assert common.stored_alone(spark, make).count() == 3
    thread.join()
    assert kept[0].count() == 7
