"""A workflow's rows are dealt by the tasks that read them."""

from pyspark.sql import functions as F

from chronoweave.streaming.workflow import Workflow


def test_no_task_deals_a_whole_batch(spark, tmp_path):
    flow = Workflow(spark, str(tmp_path), "dealt")
    rows = lambda: spark.range(0, 4000, 1, 32).withColumn("x", F.col("id") * 2)
    made = flow.run("rows", rows, "id", 2, lambda r: r)
    assert made.count() == made.distinct().count() == 4000
    for batch in (0, 1):
        assert len(list(tmp_path.glob(f"dealt/rows/dealt-*/_batch={batch}/*.parquet"))) == 32
