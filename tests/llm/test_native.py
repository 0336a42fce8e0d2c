"""Native operators run no Python on executors: neither in the plan of the result nor in any job on the way there."""

import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from isohyet import llm

NATIVE = ("op1_url_filters", "op2_quality_rules", "op4_hypergeometric_sharding", "op9_mix_sources", "op10_line_dedup")
PYTHON = re.compile(r"Python|Pandas|ArrowEval|MapInArrow|InArrow")


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.rdd().toDebugString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_on_executors(spark, monkeypatch, name):
    seen = []
    for action in ("checkpoint", "count", "collect", "first", "toArrow", "isEmpty"):
        plain = getattr(DataFrame, action)

        def watched(self, *args, _plain=plain, _action=action, **how):
            seen.append((_action, plans(self)))
            return _plain(self, *args, **how)

        monkeypatch.setattr(DataFrame, action, watched)
    result = llm.queries()[name](spark, "/root/testdata/sf0.001")
    seen.append(("result", plans(result)))
    assert not [(action, PYTHON.findall(plan)) for action, plan in seen if PYTHON.search(plan)]
    assert result.count() > 0


def test_the_watch_notices_python(spark):
    assert PYTHON.search(plans(spark.range(3).mapInArrow(lambda batches: batches, "id long")))
