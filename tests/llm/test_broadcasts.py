"""Tables are hinted for a broadcast by what they take in memory, not by their size on disk alone."""

from claimloom.llm.common import sized, table_bytes, write_table


def hinted(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def test_rows_that_shrink_on_disk(spark):
    small, path = write_table(spark.range(1000).toDF("x"), "small")
    assert hinted(sized(small, path))
    long_, path = write_table(spark.range(3_000_000).selectExpr("id DIV 1000 AS x"), "long")
    assert table_bytes(spark, path) < 1 << 20 and not hinted(sized(long_, path))
