"""As-of join without a range join: one shuffle on the key, one sorted window pass."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time."""
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)})
    names = left.columns
    r = right.select(
        *[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names],
        F.lit(0).alias("_side"),
        F.struct(*values).alias("_v"),
    )
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = l.unionByName(r).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return seen.select(*names, *[F.col(f"_last.{v}").alias(v if v not in names else f"{v}_right") for v in values])
