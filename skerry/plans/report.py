"""The plan report: which operators run, how, and what keeps parts of a plan out of generated code."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Operator -> reason it leaves whole-stage code generation or costs a pass over Python.
REASONS = {
    "BatchEvalPython": "row-at-a-time Python function",
    "ArrowEvalPython": "Arrow-batched Python function",
    "MapInArrow": "Arrow-batched Python operator",
    "MapInPandas": "pandas operator",
    "FlatMapGroupsInPandas": "pandas operator by group",
    "CartesianProduct": "no join key",
    "BroadcastNestedLoopJoin": "no equality in the join condition",
    "ObjectHashAggregate": "aggregate with object buffers",
    "SortAggregate": "aggregate buffers of variable length",
}
_LINE = re.compile(r"^[\s:+\-|]*(\*?)\s*(?:\((\d+)\)\s*)?([A-Z]\w+)(.*)$")


def explain(df: DataFrame) -> list[dict]:
    """One entry per physical operator: name, whether it is in generated code, and the recorded reason if it is not."""
    text = df._jdf.queryExecution().executedPlan().toString()
    found = []
    for line in text.splitlines():
        if m := _LINE.match(line):
            name = m[3]
            if name == "AdaptiveSparkPlan":
                continue
            found.append({"operator": name, "codegen": bool(m[1] and m[2]), "reason": REASONS.get(name), "detail": m[4].strip()[:200]})
    return found


def reasons(df: DataFrame) -> dict[str, str]:
    return {e["operator"]: e["reason"] for e in explain(df) if e["reason"]}


def pushed_filters(df: DataFrame) -> list[str]:
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PushedFilters: \[([^\]]*)\]", text)
