import pytest
from oracle import compare
from pyspark.sql import functions as F

from langloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_like_its_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", name, QUERIES[name], ORACLE_SQL[name]) is None


def test_sql_of_odd_rows(spark, odd, tmp_path):
    """Nulls, empties, repeats and a long text, in SQL as in Spark."""
    rows = odd.withColumn("text", F.substring("text", 1, 8000))
    rows.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{tmp_path}/part")
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    for t in ("benchmark", "labels"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    for name in sorted(ORACLE_SQL):
        assert compare(spark, str(tmp_path), name, QUERIES[name], ORACLE_SQL[name], ("documents", "benchmark", "labels")) is None
