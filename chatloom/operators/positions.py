"""Dense positions without a single-partition window (B9) and the positional split (G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import saved


#: Keys of one range bucket, about.
BUCKET_ROWS = 250_000


def dense_positions_by(df: DataFrame, order_cols: list[str], pos_col: str = "ord", buckets: int | None = None,
                       keys: DataFrame | None = None) -> DataFrame:
    """0-based positions in the order of several columns (any sortable types, unique together).

    Only the keys are sorted and saved: they are range-partitioned into buckets of about
    ``BUCKET_ROWS``, counted per bucket, and numbered inside their bucket; the rows then get
    their position by a join on the keys. No step sees more than one bucket. ``keys`` may be given
    where they are saved already.
    """
    keys = saved(df.select(*order_cols), "position-keys") if keys is None else keys
    n = buckets or max(1, -(-keys.count() // BUCKET_ROWS))
    ranged = saved(keys.repartitionByRange(n, *order_cols).withColumn("_bkt", F.spark_partition_id()), "position-buckets")
    counts = ranged.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select("_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_bkt").orderBy(*order_cols))
    placed = ranged.withColumn("_in", inside).join(offsets, "_bkt").select(
        *order_cols, (F.col("_off") + F.col("_in") - 1).cast("bigint").alias("_pos"))
    same = None
    right = placed.toDF(*[f"_k{i}" for i in range(len(order_cols))], "_pos")
    for i, c in enumerate(order_cols):
        one = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        same = one if same is None else same & one
    return df.join(right, same).select(*df.columns, F.col("_pos").alias(pos_col))


def dense_positions(df: DataFrame, order_col: str = "ord", pos_col: str = "pos", buckets: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_col`` order (``order_col`` unique)."""
    return dense_positions_by(df, [order_col], pos_col, buckets)


def assign_ids(df: DataFrame, order_col: str = "ord", id_col: str = "id") -> DataFrame:
    """Blank ids become ``sample_%04d`` of the 0-based position in the final dataset."""
    pos = dense_positions(df, order_col)
    blank = F.col(id_col).isNull() | (F.col(id_col) == "")
    return pos.withColumn(id_col, F.when(blank, F.format_string("sample_%04d", F.col("pos"))).otherwise(F.col(id_col)))


def train_eval_split(df: DataFrame, order_col: str = "ord", eval_fraction: float = 0.1, train_fraction: float = 0.9,
                     mode: str = "positional") -> DataFrame:
    """Flags ``is_train`` / ``is_eval`` by position.

    ``positional`` reproduces the two independent slices: train = first ``int(n*0.9)``,
    eval = last ``max(1, int(n*eval_fraction))`` (they can overlap or leave a gap).
    ``partition`` makes eval the exact complement of train.
    """
    if not (0.0 < eval_fraction < 1.0):
        raise ValueError(f"eval_fraction must be in (0, 1), got {eval_fraction!r}")
    pos = saved(dense_positions(df.select(order_col), order_col), "split-positions")
    n = pos.count()
    n_train = int(n * train_fraction)
    n_eval = max(1, int(n * eval_fraction))
    is_train = F.col("pos") < F.lit(n_train)
    if mode == "partition":
        is_eval = ~is_train
    elif mode == "positional":
        is_eval = F.col("pos") >= F.lit(n - n_eval)
    else:
        raise ValueError(f"unknown split mode {mode!r}")
    flags = pos.withColumn("is_train", is_train).withColumn("is_eval", is_eval)
    return df.join(flags, order_col)


def group_positions(df: DataFrame, group_cols: list[str], order_cols: list[str], pos_col: str = "pos") -> DataFrame:
    """0-based position inside each group without a per-group window: a global dense
    position in (group, order) order minus the group's first position (an aggregate).
    A group holding a third of all rows is still spread over many range buckets."""
    g = dense_positions_by(df, group_cols + order_cols, "_gpos")
    first = g.groupBy(*group_cols).agg(F.min("_gpos").alias("_gmin"))
    return g.join(first, group_cols).withColumn(pos_col, F.col("_gpos") - F.col("_gmin")).drop("_gpos", "_gmin")
