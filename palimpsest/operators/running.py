"""Running sums over a long order, without one task per key.

Rows are cut into stretches of the order; a stretch is a window partition of its
own, and what is ahead of it comes from a window over one row a key and stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 20


def running_sum(df: DataFrame, keys: list[str], value: Column, out: str, inclusive: bool = True, order: str = "seq", stretch: int = STRETCH) -> DataFrame:
    """Adds the sum of ``value`` over the key's rows up to (and with) the row; ``order`` is unique a key."""
    cut = df.withColumn("__stretch", F.floor(F.col(order) / stretch)).withColumn("__v", value)
    w = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy(*keys, "__stretch").agg(F.sum("__v").alias("__s")).select(*keys, "__stretch", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__ahead"))
    inner = Window.partitionBy(*keys, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = cut.join(ahead, [*keys, "__stretch"])
    return joined.select(*df.columns, (F.col("__ahead") + F.coalesce(F.sum("__v").over(inner), F.lit(0))).alias(out))
