import pytest
from hard_rows import HARD


@pytest.fixture
def hard(spark):
    rows = [(i, t, "x", k, k, "c", True, "r") for k, (i, t) in enumerate(HARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, uid int, key string, kept boolean, bands string")


@pytest.fixture
def empty(hard):
    return hard.filter("1 = 0")


@pytest.fixture
def exchanged(spark):
    """Bytes that a frame's evaluation shuffles, when no table is small enough for a broadcast."""
    def size(plan):
        own = plan.metrics().get("dataSize").get().value() if plan.getClass().getSimpleName() == "ShuffleExchangeExec" else 0
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan",
                 "ResultQueryStageExec": "plan"}.get(plan.getClass().getSimpleName())
        below = [getattr(plan, inner)()] if inner else [plan.children().apply(k) for k in range(plan.children().size())]
        return own + sum(map(size, below))

    def evaluated(df):
        df.collect()
        return size(df._jdf.queryExecution().executedPlan())

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield evaluated
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
