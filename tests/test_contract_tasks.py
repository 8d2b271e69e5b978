"""Key checks over tables of mostly different keys are counted in a fixed number of tasks."""

from __future__ import annotations

import __spark_entry__ as entry
from wardscope.operators import contract as C


def test_results_do_not_depend_on_the_tasks(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (None, 1), (3, None), (4, 2)], "k long, r int")
    for make in (lambda n: C.unique(rows, ["k"], "key", n), lambda n: C.unique(rows, ["k", "r"], "row", n), lambda n: C.prefix_ranks(rows, ["k"], "r", "ranks", n)):
        assert sorted(map(tuple, make(5).collect())) == sorted(map(tuple, make(None).collect())) != []


def test_lines_are_dealt_to_a_fixed_number_of_tasks(spark):
    found = entry.queries()["q29_contract_uniqueness"](spark, "/root/testdata/sf0.001")
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert plan.count("REPARTITION_BY_NUM") == 3 and "ENSURE_REQUIREMENTS" not in plan
