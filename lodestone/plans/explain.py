"""explain: the normalised command with Spark's plan of it."""

from __future__ import annotations

import re

from ..errors import fail


def explain(db, command: dict) -> dict:
    """Stages of a read, whether its filter reaches the scan, and the formatted plan."""
    name = next(iter(command), None)
    if name not in ("find", "count", "aggregate"):
        fail("VAL_UNSUPPORTED_COMBINATION", "explain takes a read")
    plan = db.run(command)._jdf.queryExecution().explainString(db.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = re.findall(r"PushedFilters: \[(.*)\]", plan)
    stages = [next(iter(s)) for s in command["pipeline"]] if name == "aggregate" else [k for k in ("filter", "sort", "skip", "limit", "projection") if k in command]
    return {
        "command": name,
        "stages": stages,
        "pushed_filters": pushed,
        "read_schema": re.findall(r"ReadSchema: (.*)", plan),
        "reasons": ["FILTER_PUSHED" if any(pushed) else "FULL_SCAN", "TOP_K" if "TakeOrderedAndProject" in plan else "SORT" if re.search(r"\bSort\b", plan) else "NO_ORDER"],
        "plan": plan,
    }
