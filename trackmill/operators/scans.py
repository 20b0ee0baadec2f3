"""Running products of matrices over long series, in two levels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geometry import product
from trackmill.sources.stored import stored


def _running(df: DataFrame, keys: list[str], order: str, matrix: str, result: str) -> DataFrame:
    """df with the running products of each group in order, each scaled to a last element of one where that isn't 0. Tasks walk through their sorted groups."""
    ordered = df.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.eye(3)
        for batch in batches:
            first = batch.column(batch.schema.get_field_index("__first")).to_numpy(zero_copy_only=False)
            steps = batch.column(batch.schema.get_field_index(matrix))
            out = np.empty((batch.num_rows, 9))
            for k in range(batch.num_rows):
                total = np.eye(3) if first[k] else total
                if steps[k].is_valid:
                    total = np.asarray(steps[k].as_py(), float).reshape(3, 3) @ total
                    total = total / (total[2, 2] if abs(total[2, 2]) > 1e-12 else 1.0)
                out[k] = total.ravel()
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, 9 * len(out) + 1, 9, dtype=np.int32)), pa.array(out.ravel()))
            keep = [n for n in batch.schema.names if n not in ("__first", result)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in keep], made], [*keep, result])

    fields = [*[f"`{c}` {t}" for c, t in df.dtypes if c != result], f"`{result}` array<double>"]
    return ordered.mapInArrow(walk, ", ".join(fields))


def prefix_products(df: DataFrame, keys: list[str], order: str, matrix: str, block: int = 1024) -> DataFrame:
    """df with `product`: the running product (row-major) of 3x3 matrices in order of the whole number `order`; a null matrix is no motion. [WIN-20]

    The product is associative but does not commute, so it is a scan: blocks of `block` numbers are multiplied up each by itself, the blocks' totals in
    order, and every row's product within its block times what came before. No series is walked through as a whole but its blocks' totals: a thousandth of its rows.
    """
    blocked = df.withColumn("__block", F.floor(F.col(order) / block).cast("long"))
    local = stored(_running(blocked, [*keys, "__block"], order, matrix, "product"), "products")
    totals = local.groupBy(*keys, "__block").agg(F.max_by("product", order).alias("total"))
    ahead = _running(totals, keys, "__block", "total", "up_to")
    ahead = ahead.withColumn("before", F.lag("up_to").over(Window.partitionBy(*keys).orderBy("__block")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"a.{k}")) for k in [*keys, "__block"]]
    both = local.alias("l").join(ahead.select(*keys, "__block", "before").alias("a"), same)
    one = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    m = product([F.col("l.product")[i] for i in range(9)], [F.coalesce("a.before", one)[i] for i in range(9)])
    scale = F.when(F.abs(m[8]) > 1e-12, m[8]).otherwise(1.0)
    return both.select(*[F.col(f"l.{c}") for c in df.columns if c != "product"], F.array(*[v / scale for v in m]).alias("product"))
