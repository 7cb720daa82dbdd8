"""Steps that must not gather most rows in a few tasks."""

from __future__ import annotations

import re

from __spark_entry__ import queries
from conftest import executed_plan


def test_values_are_not_shuffled_by_their_measure(spark, sf_dir):
    """There are two measures: a join by measure put all values into two tasks."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed_plan(queries()["profile_from_daily_sketches"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not re.search(r"hashpartitioning\(m#", plan)
