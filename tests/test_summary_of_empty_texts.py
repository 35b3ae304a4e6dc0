"""The corpus summary of empty and null texts: the query as its SQL, the operator as the reference."""

import duckdb
import pytest

from tessera.operators import catalog
from tessera.plans import registry

ROWS = [(1, "two words"), (2, ""), (3, None), (4, " \n\t"), (5, "ä b  c d"), (6, "")]


@pytest.mark.parametrize("keep", [ROWS, ROWS[1:2], []])
def test_summary_agrees_with_sql(spark, tmp_path, keep):
    docs = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in keep], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["corpus_token_summary"])
    got = registry.QUERIES["corpus_token_summary"](spark, str(tmp_path))
    assert got.columns == want.columns
    assert [tuple(r) for r in got.collect()] == want.fetchall()


def test_operator_counts_empty_texts_as_failed(spark):
    got = catalog.corpus_summary(catalog.text_stats(spark.createDataFrame(ROWS, "doc_id long, text string"))).first()
    assert (got.total_documents, got.successful, got.failed, got.total_word_counts) == (6, 3, 3, 6)
