import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

REPO = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_entry_without_optional_parts():
    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", ["document_context", "chunk_sentence_500_100", "validate_batch", "merge_duplicate_edges", "model_ranking", "knn_cosine", "progress_rate_eta"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    text = lambda df: sorted(map(tuple, df[cols].map(lambda x: f"{x:.7g}" if isinstance(x, float) else str(x)).values))
    assert text(want) == text(got)


@pytest.mark.parametrize("name", ["extract_relations_proximity", "topics_top10", "validate_batch", "latest_state", "graph_statistics"])
def test_plans_scale(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not any("Window" in a and "SinglePartition" in b for a, b in zip(plan.split("\n"), plan.split("\n")[2:], strict=False))
