from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from disputeflow.operators import features, skew
from disputeflow.streaming import jobs


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def fact(spark, n=30_000):
    """A third of the rows belongs to one customer, a tenth to none."""
    key = (
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 10 == 1, None)
        .otherwise(F.concat(F.lit("c"), (F.col("id") % 7001).cast("string")))
    )
    return spark.range(n).select(F.col("id").cast("string").alias("transaction_id"),
                                 key.alias("customer_id"))


def test_hot_keys_are_few(spark):
    (hot,) = skew.replication(fact(spark), "customer_id").collect()
    assert hot["customer_id"] == "hot"
    assert 333 <= hot[skew.COPIES] <= 1000  # about as many as it holds thousandths of the rows


def test_join_is_complete_and_spread(spark, no_broadcast):
    left = fact(spark)
    right = left.select("customer_id").distinct().where("customer_id IS NOT NULL").where(
        "customer_id <> 'c5'"
    ).withColumn("value", F.length("customer_id"))
    joined = skew.join_dimension(left, right, "customer_id")
    plain = left.join(right, "customer_id", "left")
    assert sorted(joined.columns) == sorted(plain.columns)
    assert joined.select(*plain.columns).exceptAll(plain).count() == 0
    assert joined.count() == plain.count() == 30_000

    def largest(frame):
        sizes = frame.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("value")  # the sum keeps the join in the plan
        )
        return max(r["n"] for r in sizes.collect())

    assert largest(plain) > 10_000  # the hot customer sits in one task
    assert largest(joined) < 6_500  # 30,000 rows over 8 tasks


def test_customer_join_uses_the_balanced_join(spark, no_broadcast):
    customers = spark.createDataFrame(
        [("hot", 1, 1, 1, 1, 1, 1, 1.0)],
        "customer_id string, account_age_days int, previous_transactions int, "
        "successful_transactions int, previous_chargebacks int, previous_refunds int, "
        "known_devices int, average_order_value double",
    )
    joined = features.with_customers(fact(spark), customers)
    assert joined.where("known_devices = 1").count() == 10_000
    assert joined.count() == 30_000


def test_equal_ids_are_spread_too(spark, no_broadcast):
    """Requests without an id all get the same default id."""
    left = fact(spark).select(
        F.lit("default").alias("transaction_id"),
        F.lit(1).alias("query_id"),
        F.col("transaction_id").cast("double").alias("amount"),
    )
    right = spark.createDataFrame([(1, 5)], "query_id int, value int")
    sizes = (
        skew.join_dimension(left, right, "query_id")
        .groupBy(F.spark_partition_id().alias("p"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
        .collect()
    )
    assert sum(r["v"] for r in sizes) == 150_000
    assert max(r["n"] for r in sizes) < 8_000


def largest_task(frame):
    sizes = frame.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("known_devices"))
    return max(r["n"] for r in sizes.collect())


CUSTOMER = (
    "customer_id string, account_age_days int, previous_transactions int, successful_transactions int, "
    "previous_chargebacks int, previous_refunds int, known_devices int, average_order_value double"
)


@pytest.mark.parametrize("n", [20_000, 80_000])
def test_largest_task_follows_the_number_of_tasks(spark, no_broadcast, n):
    """With a third of the rows on one customer, more tasks mean smaller ones, at any size."""
    customers = spark.createDataFrame([("hot", 1, 1, 1, 1, 1, 1, 1.0)], CUSTOMER)
    hot = skew.replication(fact(spark, n), "customer_id").persist()
    try:
        for tasks in (8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            assert largest_task(features.with_customers(fact(spark, n), customers, hot)) < 2.2 * n / tasks
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("n", [20_000, 80_000])
def test_stream_spreads_a_hot_customer(spark, no_broadcast, tmp_path, n):
    """The stream-static join uses the stored replication table; its batch is spread like a table."""
    source, columns = str(tmp_path / "in"), "transaction_id, customer_id"
    sent = fact(spark, n).selectExpr(
        "transaction_id", "customer_id", "1.0D AS amount", "'card' AS payment_method", "'success' AS authentication_status",
        "timestamp'2026-01-01' AS transaction_time", "1 AS previous_transactions",
    )
    sent.coalesce(1).write.parquet(source)
    customers = spark.createDataFrame([("hot", 1, 1, 1, 1, 1, 1, 1.0)], CUSTOMER)
    orders = spark.createDataFrame([], "transaction_id string, product_category string, product_value double, "
                                       "delivery_status string, refund_status string")
    hot = skew.replication(spark.read.parquet(source).selectExpr(*columns.split(", ")), "customer_id")
    hot.write.parquet(str(tmp_path / "hot"))
    stream = jobs.read_stream(spark, source, sent.schema)
    sizes = []

    def each(batch, _):
        # the join with the orders is on the transaction, which deals rows anew: look below it
        sizes.append(largest_task(batch))

    joined = features.with_customers(stream, customers, spark.read.parquet(str(tmp_path / "hot")))
    jobs.start_batches(joined, each, str(tmp_path / "cp")).awaitTermination()
    assert sizes and max(sizes) < 2.2 * n / 8
    enriched = jobs.enrich(stream, customers, orders, hot=spark.read.parquet(str(tmp_path / "hot")))
    jobs.start_table(enriched.select("transaction_id", "known_devices"), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == n and done.where("known_devices = 1").count() == fact(spark, n).where("customer_id = 'hot'").count()
