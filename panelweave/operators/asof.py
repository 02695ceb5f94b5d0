"""As-of join: every row of one frame with the nearest row of another by time, per key, without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.blocks import with_block_summary

#: Length of a time block: a task holds the rows of one key (and salt) in one block.
BLOCK_SECONDS = 30 * 86400


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str = "ts", right_time: str = "ts", into: str = "match",
              forward: bool = False, within: int | None = None, block_seconds: int = BLOCK_SECONDS, salts: int = 1) -> DataFrame:
    """All rows and columns of ``left`` and, as the struct ``into``, the last row of ``right`` of equal keys at or before their time.

    ``forward`` takes the first row at or after it instead, ``within`` (seconds) leaves out rows further away. Rows without
    such a partner, with a NULL time or with a NULL key get NULL. Of several rows of ``right`` at one time the one with the
    largest hash of its columns counts (maps and variants aside), so the choice does not depend on the order of rows.

    Both frames become one, ordered by time inside blocks; one row per block carries the last row of ``right`` into the blocks
    after it. Nothing is paired, so the work is one exchange and one sort of both, whatever the distances. For a key with
    many rows in one block, ``salts`` deals its rows of ``left`` over that many tasks and repeats those of ``right``.
    """
    if into in left.columns:
        raise ValueError(f"{into!r} is a column of the left frame already")
    # Backwards, time runs up; forwards, it runs down, and the nearest row is the last one again.
    turn = -1 if forward else 1
    names = [f"_k{i}" for i in range(len(keys))]

    def hashed(df: DataFrame, row: str) -> Column:
        return F.xxhash64(*[F.col(f"{row}.`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"])

    def placed(df: DataFrame, row: str, time: str, side: int, tie: Column) -> list[Column]:
        at = F.unix_micros(F.col(f"{row}.`{time}`").cast("timestamp")) * turn
        return [*[F.col(f"{row}.`{k}`").alias(n) for k, n in zip(keys, names)], F.named_struct(F.lit("at"), at, F.lit("side"), F.lit(side), F.lit("tie"), tie).alias("_order")]

    ours = left.select(F.struct("*").alias("_left"))
    ours = ours.select("_left", F.pmod(hashed(left, "_left"), F.lit(salts)).cast("int").alias("_salt"), *placed(left, "_left", left_time, 1, F.lit(0).cast("long")))
    theirs = right.filter(F.col(f"`{right_time}`").isNotNull()).select(F.struct("*").alias("_row"))
    theirs = theirs.select("_row", *placed(right, "_row", right_time, 0, hashed(right, "_row"))).dropna(subset=names)
    theirs = theirs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(*names, "_salt", "_order", F.struct(F.col("_order.at").alias("at"), F.col("_row").alias("row")).alias("_right"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    by = [*names, "_salt"]
    block = F.floor(F.col("_order.at") / F.lit(block_seconds * 1_000_000)).cast("long")
    carried = with_block_summary(
        both, [F.max_by("_right", F.when(F.col("_order.side") == 0, F.col("_order"))).alias("_last")],
        lambda w: [F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("right")],
        by, order="_order", block=block)
    local = Window.partitionBy(*by, "block").orderBy(F.col("_order").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_right", ignorenulls=True).over(local), F.col("carry.right"))
    near = F.col("_found.row")
    if within is not None:
        near = F.when(F.col("_order.at") - F.col("_found.at") <= within * 1_000_000, near)
    return carried.withColumn("_found", found).filter(F.col("_order.side") == 1).select("_left.*", near.alias(into))
