"""Global row numbers and running sums do not depend on the other columns of the table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.operators.analytics import global_cumsum, global_row_number


def test_wide_rows_get_the_plain_windows_numbers(spark):
    wide = spark.range(25_000, numPartitions=7).select(
        F.col("id"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("price"),
        *[F.concat(F.lit(f"c{i}-"), F.col("id")).alias(f"c{i}") for i in range(8)])
    order = [F.desc("price"), F.asc("id")]
    w = Window.orderBy(*order)
    want = wide.select("id", F.row_number().over(w).alias("w"), F.sum("price").over(w).alias("s"))
    got = global_row_number(wide, order, num_partitions=16).join(want, "id")
    assert got.count() == 25_000 and got.where("row_no <> w").isEmpty()
    sums = global_cumsum(wide, order, F.col("price"), "total", num_partitions=16).join(want, "id")
    assert sums.where("total <> s").isEmpty()
