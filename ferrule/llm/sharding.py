"""Proportional stratified interleaving into shards of near-equal row counts.

Rows are shuffled within each stratum by a seeded hash and ranked there from 1
to n; a row's fractional rank is (2 rank - 1) / 2n.  Sorted by fractional rank
the strata are mixed evenly at every place, so cutting the order into pieces of
equal length gives every shard the mixture of the whole.  Row counts of shards
differ by one at most, and a shard's slots are gapless from 0.

Neither ranking puts a stratum or the table into one task: rows are counted in
buckets of the hash (then of the fractional rank), the counts are summed up over
runs of buckets and within each run, and only the rows of one bucket are sorted
together.  The hash covers every column, so rows that share an id (or have
none) spread like others.  Rows that are equal in every column share one place
in the first ranking and take as many ranks as there are copies, so a row that
is repeated very often is no hot group.

Nulls: a null stratum is a stratum of its own; nulls are hashed like a value.
Ties in the hash are broken by the columns, so only equal rows are exchangeable.
Very long texts are hashed whole.  An empty table gives an empty table.  Columns
named ``shard`` or ``slot`` (in any case) are replaced; all others are kept, whatever
their names.  Columns must be of types that can be grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .naming import numbered, own, place, restored

#: Rows that one bucket holds on average; a bucket is sorted in one task.
BUCKET_ROWS = 4_000
#: Buckets whose counts are summed up in one task; their runs are summed up in another.
RUN_BUCKETS = 1_024


def _hash60(*cols) -> F.Column:
    """60 bits of a seeded md5, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def _summed_before(counts: DataFrame, bucket: str, keys: list[str]) -> DataFrame:
    """Add ``_before``, the sum of ``_n`` over smaller buckets of the same keys, by runs of ``RUN_BUCKETS``."""
    run = F.floor(F.col(bucket) / RUN_BUCKETS).alias("_run")
    earlier = (Window.unboundedPreceding, -1)
    runs = counts.groupBy(*keys, run).agg(F.sum("_n").alias("_n"))
    over_runs = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_run").rowsBetween(*earlier))
    runs = runs.select(*(F.col(k).alias(f"{k}_r") for k in keys), F.col("_run").alias("_run_r"), F.coalesce(over_runs, F.lit(0)).alias("_runs_before"))
    inner = F.sum("_n").over(Window.partitionBy(*keys, "_run").orderBy(bucket).rowsBetween(*earlier))
    counts = counts.withColumn("_run", run).withColumn("_in_run", F.coalesce(inner, F.lit(0)))
    same = F.col("_run") == F.col("_run_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    joined = counts.join(runs, same).withColumn("_before", F.col("_runs_before") + F.col("_in_run"))
    return joined.drop("_run", "_run_r", "_runs_before", "_in_run", *(f"{k}_r" for k in keys))


def interleave(df: DataFrame, ids: list[str], stratum: str, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with shard (0 to shards - 1) and slot (place in the shard); ``ids`` come first in the seeded hash."""
    if shards < 1:
        raise ValueError("at least one shard")
    added = ("shard", "slot")
    own_names = [i for i, n in enumerate(df.columns) if n.lower() not in added]
    names = [f"_c{i}" for i in own_names]
    first = [f"_c{place(df, c)}" for c in ids]
    total = df.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    copies = numbered(df).groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    hashed = [*first, *(c for c in names if c not in first)]
    keyed = copies.withColumns({"_s": own(df, stratum), "_h": _hash60(F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in hashed))})
    keyed = keyed.withColumn("_b", (F.shiftright("_h", 20) * buckets / F.lit(1 << 40)).cast("int"))

    # Ranks within the stratum: what earlier buckets hold, and the order within the bucket.
    counts = _summed_before(keyed.groupBy("_s", "_b").agg(F.sum("_copies").alias("_n")), "_b", ["_s"])
    sizes = keyed.groupBy("_s").agg(F.sum("_copies").alias("_size")).withColumnRenamed("_s", "_s3")
    counts = counts.join(sizes, F.col("_s").eqNullSafe(F.col("_s3"))).select(F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), "_before", "_size")
    ranked = keyed.join(counts, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    order = [F.col("_h"), *(F.col(c) for c in names)]
    within = Window.partitionBy("_s", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    # Copies become rows by runs, so that no array grows with the number of copies.
    last = F.col("_first") + F.col("_copies")
    ranked = ranked.withColumn("_run", F.explode(F.sequence(F.col("_first") + 1, last, F.lit(BUCKET_ROWS).cast("long"))))
    ranked = ranked.withColumn("_rank", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + BUCKET_ROWS - 1, last))))

    # The same again over all strata, by fractional rank.
    ranked = ranked.withColumn("_f", (2 * F.col("_rank") - 1) / (2 * F.col("_size")))
    ranked = ranked.withColumn("_g", F.least((F.col("_f") * buckets).cast("int"), F.lit(buckets - 1)))
    ranked = ranked.select(*names, "_s", "_h", "_f", "_g")
    held = _summed_before(ranked.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")), "_g", [])
    placed = ranked.join(held.select(F.col("_g").alias("_g2"), "_before"), F.col("_g") == F.col("_g2"))
    final = Window.partitionBy("_g").orderBy("_f", F.col("_s").asc_nulls_first(), *order)
    placed = placed.withColumn("_place", F.col("_before") + F.row_number().over(final) - 1)

    # Shard k holds the places from floor(k * total / shards) on.
    shard = F.expr(f"((_place + 1) * {shards} - 1) div {max(total, 1)}")
    return placed.withColumn("_k", shard).select(
        *restored(df, without=added),
        F.col("_k").cast("int").alias("shard"),
        (F.col("_place") - F.expr(f"(_k * {total}) div {shards}")).alias("slot"),
    )


def write_shards(df: DataFrame, path: str) -> None:
    """Write the rows of ``interleave`` as Parquet, one folder a shard, in slot order."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
