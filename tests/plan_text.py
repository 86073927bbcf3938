"""What tests read from a query plan."""


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
