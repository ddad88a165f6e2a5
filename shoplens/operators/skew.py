"""Skew-safe bounded window frames.

``rows between n preceding and 1 preceding`` partitioned by user puts all of a
user's rows in one task; with one user holding a large share of the log that
task holds the skew. ``prior_rows`` gives the same frame exactly while cutting
the log into chunks of about equally many rows:

1. the rows are range-partitioned by (key, time, tie-break); the partition is
   the chunk. Spark places the cuts by a sample of the rows, so a user with a
   third of all rows, or a burst of equal times, spans many chunks, and small
   users share one;
2. the last n rows of every (key, chunk) (a window limit, pre-applied map side);
3. halo of a chunk = the n rows before its first tail row in that small
   tail table (partitioned by user, n rows per chunk only);
4. the frame inside each (key, chunk) plus the halo in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.session import cut_lineage


def with_chunks(df: DataFrame, key: str, ts: str, tiebreak: str, chunks: int | None = None) -> DataFrame:
    """Add ``_chunk``: contiguous pieces of the order by (key, ts, tiebreak), of about equally many rows."""
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(key), F.col(ts), F.col(tiebreak))
    # written: all that reads the chunks must see the same cuts
    return cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()))


def keyed_cumsum(df: DataFrame, key: str, ts: str, tiebreak: str, value: Column, name: str,
                 chunks: int | None = None) -> DataFrame:
    """Running sum of ``value`` per key in (ts, tiebreak) order, chunk by chunk:
    a local running sum inside each (key, chunk) plus the totals of the key's
    earlier chunks (a table of one row per chunk)."""
    d = with_chunks(df.withColumn("_v", value), key, ts, tiebreak, chunks)
    order = [F.col(ts), F.col(tiebreak)]
    local = d.withColumn("_loc", F.sum("_v").over(
        Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = d.groupBy(key, "_chunk").agg(F.sum("_v").alias("_tot"))
    offs = totals.select(key, "_chunk", F.coalesce(F.sum("_tot").over(
        Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"))
    offs = offs.withColumnsRenamed({key: "_key", "_chunk": "_part"})
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_part"))
    return (local.join(offs, same).drop("_key", "_part").withColumn(name, F.col("_off") + F.col("_loc"))
            .drop("_v", "_loc", "_off", "_chunk"))


def prior_rows(df: DataFrame, key: str, ts: str, tiebreak: str, n: int, payload: Column,
               name: str = "_prior", chunks: int | None = None) -> DataFrame:
    """Add ``name`` = array of the payloads of the (up to) n rows before each row
    of the same key, ordered by (ts, tiebreak), oldest first."""
    d = with_chunks(df.withColumn("_p", payload), key, ts, tiebreak, chunks)
    order = [F.col(ts), F.col(tiebreak)]
    in_chunk = Window.partitionBy(key, "_chunk")
    tails = (d.withColumn("_rd", F.row_number().over(in_chunk.orderBy(*[o.desc() for o in order])))
             .where(F.col("_rd") <= n).select(key, "_chunk", ts, tiebreak, "_p"))
    t_prev = Window.partitionBy(key).orderBy(*order).rowsBetween(-n, -1)
    halo = (tails.withColumn("_h", F.collect_list("_p").over(t_prev))
            .withColumn("_ra", F.row_number().over(in_chunk.orderBy(*order)))
            .where(F.col("_ra") == 1).select(key, "_chunk", "_h"))
    local = d.withColumn("_loc", F.collect_list("_p").over(in_chunk.orderBy(*order).rowsBetween(-n, -1)))
    both = F.concat(F.coalesce(F.col("_h"), F.array().cast(local.schema["_loc"].dataType)), F.col("_loc"))
    halo = halo.withColumnsRenamed({key: "_key", "_chunk": "_part"})
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_part"))
    return (local.join(halo, same, "left").drop("_key", "_part")
            .withColumn(name, F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n))
            .drop("_h", "_loc", "_chunk", "_p"))
