import os
import time

import pytest

from cleanframe import session
from cleanframe.plans.pipeline import run_steps
from cleanframe.plans.spec import Op, Step
from cleanframe.session import SHUFFLE_CLEANUP, all_written_alone, release, scratch, shared_dir, written, written_alone


def left(spark):
    top = f"{shared_dir(spark)}/cleanframe".removeprefix("file:")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_scratch_tables_end_with_their_context(spark):
    before = left(spark)
    with scratch(spark):
        df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 1)], "k string, n int")
        assert run_steps(df, Step(Op.SORT_COLUMN, "k")).count() == 3
        assert left(spark) > before
    assert left(spark) == before


def test_one_table_stays(spark):
    before = left(spark)
    kept = written_alone(spark, lambda: written(written(spark.range(5), "a"), "b"), "kept")
    assert kept.count() == 5 and len(left(spark) - before) == 1
    release(spark, since=len(session._MADE) - 1)
    assert left(spark) == before


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {p for k in range(files.size()) if os.path.basename(p := files.apply(k).getPath()).startswith("shuffle_")}


@pytest.mark.parametrize("said", [None, "false"])
def test_shuffle_files_end_with_the_write(spark, said):
    if said:
        spark.conf.set(SHUFFLE_CLEANUP, said)
    held = spark.conf.get(SHUFFLE_CLEANUP, None)
    before = shuffle_files(spark)
    groups = spark.range(20_000).selectExpr("id % 7000 k").groupBy("k").count()
    with scratch(spark):
        tables = [written(groups), written_alone(spark, lambda: groups)]
        for _ in range(100):  # executors delete them a moment later
            if not (rest := shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not rest and spark.conf.get(SHUFFLE_CLEANUP, None) == held
        assert [t.count() for t in [*tables, groups, groups]] == [7000] * 4  # the DataFrame can be used again
    spark.conf.unset(SHUFFLE_CLEANUP)


def test_all_tables_stay(spark):
    before = left(spark)

    def make():
        first = written(spark.range(5), "a")
        return [first.filter("id > 1"), first.filter("id < 1")]

    with scratch(spark):
        assert [t.count() for t in all_written_alone(spark, make, "b", "c")] == [3, 1]
        assert sorted(p.rsplit("-", 1)[0] for p in left(spark) - before) == ["b", "c"]
