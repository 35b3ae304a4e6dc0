"""Plans of all core queries: no product of two tables, no window over all rows."""

import re

import pytest

from tessera.functions import tables
from tessera.operators import parsing
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
#: Comparing every vector with a stated set of queries is what this query is for.
PRODUCTS = {"cosine_similarity"}


def _windows_over_all(plan):
    """Windows whose input was brought into one partition for them."""
    lines = plan.split("\n")
    return [a for a, *near in zip(lines, lines[1:], lines[2:], lines[3:]) if re.search(r"\bWindow \[", a) and any("SinglePartition" in x for x in near) and "__run" not in a]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - PRODUCTS))
def test_plans_scale(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if df.isStreaming:
        return
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    for line in plan.split("\n"):
        if "BroadcastNestedLoopJoin" in line:
            assert _one_row(df), line
    assert not _windows_over_all(plan)


def _one_row(df):
    """Whether every side that is joined without a condition is an aggregate without keys, or a constant list."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(plan):
        if re.search(r"\bJoin (Cross|Inner|LeftOuter)(, true|$)", line.strip(" :+-")) or re.search(r"Join \w+, true", line):
            below = depth(line) + 3
            sides = [x.lstrip(" :+-") for x in plan[k + 1 :] if depth(x) == below][:2]
            if not any(re.match(r"(Aggregate \[(count|sum|avg|min|max|coalesce|collect|cast|\()|Project|LocalRelation|Filter|GlobalLimit)", s) for s in sides):
                return False
    return True


def test_numbered_rows(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as k", "id % 3 as g")
    got = tables.numbered(rows, "place", "g", "k").collect()
    assert [(r.g, r.k) for r in sorted(got, key=lambda r: r.place)] == sorted((r.g, r.k) for r in got) and sorted(r.place for r in got) == list(range(1, 1001))
    assert tables.numbered(rows.limit(0), "place", "k").count() == 0


def test_brackets_of_any_depth(spark):
    deep = "[" * 60_000
    cases = {"deep": deep, "late": deep + ' {"a": 1}', "inner": deep + "[1, [2]]", "closed": deep + "]" * 60_000, "mixed": deep + '{"b": [3]}' + deep, "half": deep + "[[4]]" + "]" * 700}
    got = {r.case: r.json for r in parsing.extract_json(spark.createDataFrame([*cases.items()], "case string, response string")).collect()}
    assert got["deep"] is None and got["late"] == '{"a": 1}' and got["inner"] == "[1, [2]]" and got["mixed"] == '{"b": [3]}'
    assert got["half"] == "[" * 700 + "[[4]]" + "]" * 700 and got["closed"].strip("[") == got["closed"].lstrip("[") and got["closed"].count("[") == got["closed"].count("]") > 900
