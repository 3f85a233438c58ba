"""What an operator leaves behind when a stage fails."""

import os

import pytest
from pyspark.sql import functions as F

from strandlake.llm.common import BATCH, Scope, work_dir


def test_a_failing_stage_leaves_nothing(spark):
    folder = work_dir(spark).removeprefix("file://")
    before, settings = set(os.listdir(folder)), {k: spark.conf.get(k) for k in BATCH}
    good = spark.range(3)
    bad = good.select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    for step in ("table", "result"):
        scope = Scope(spark)
        scope.table(good, "first")
        with pytest.raises(Exception, match="no"):
            getattr(scope, step)(bad, "second")
        assert {k: spark.conf.get(k) for k in BATCH} == settings and not scope.paths
    with pytest.raises(ZeroDivisionError), Scope(spark) as scope:
        scope.table(good, "first")
        1 / 0
    assert {k: spark.conf.get(k) for k in BATCH} == settings
    left = {x for x in os.listdir(folder) if "first" in x}
    assert not left - before
    scope = Scope(spark)
    out = scope.result(scope.table(good, "first"), "whole")
    assert out.count() == 3 and not {x for x in os.listdir(folder) if "first" in x}
