"""Running values along ordered rows of a key in two levels, so that a key of any size is spread over all tasks.

A window gives each key to one task. Here rows are dealt by range of key and order, so that a large key lies in several parts one after another. Each part is scanned by itself; what the parts
before it amount to is carried in from a table with a row for each part of the few keys that span parts, of which there are fewer than two a part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.sources.scratch import Tables


@dataclass(frozen=True)
class Running:
    """A value so far, the row itself included: sum, count (of rows where value is true), max, min, or last (the value of the last row where it is not null)."""

    kind: str
    value: Column

    def local(self, w) -> Column:
        v = self.value
        return {"sum": lambda: F.sum(v), "count": lambda: F.sum(F.coalesce(v, F.lit(False)).cast("long")), "max": lambda: F.max(v), "min": lambda: F.min(v), "last": lambda: F.last(v, ignorenulls=True)}[self.kind]().over(w)

    def over_parts(self, c: Column, w) -> Column:
        """What the parts before amount to, from what each amounts to."""
        return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": lambda x: F.last(x, ignorenulls=True)}[self.kind](c).over(w)

    def joined(self, carry: Column, own: Column) -> Column:
        if self.kind in ("sum", "count"):
            return F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(carry + own)
        return {"max": lambda: F.greatest(carry, own), "min": lambda: F.least(carry, own), "last": lambda: F.coalesce(own, carry)}[self.kind]()


def scan(df: DataFrame, keys: list[str], order: list[Column | str], running: dict[str, Running], part_rows: int = 1_000_000, tables: Tables | None = None) -> DataFrame:
    """df with a column for each running value; equal to windows over keys and order, which must tell a key's rows apart.

    One count and two shuffles: the rows by range, written so that the parts stay what they are, then their parts. Rows of no key are more than a part's, however the keys are
    distributed. Null keys are a key; an empty table gives no rows. Columns _part and _carry_* are the scan's own.
    """
    tables = tables or Tables(df.sparkSession)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = max(1, -(-df.count() // part_rows))
    rows = tables.save(df.repartitionByRange(parts, *[F.col(k) for k in keys], *by).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {"sum": F.sum, "max": F.max, "min": F.min}
    # what each part of a key that has several amounts to: fewer rows than twice the parts, whatever the number of keys
    several = rows.groupBy(*keys).agg(F.min("_part").alias("_a"), F.max("_part").alias("_b")).filter("_a < _b")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    spread = rows.join(F.broadcast(several.select(*[F.col(k).alias(f"_k_{k}") for k in keys])), on, "left_semi")

    def total(r: Running) -> Column:
        if r.kind == "count":
            return F.count_if(r.value)
        if r.kind == "last":
            # the largest place in the order whose value is not null
            return F.max_by(r.value, F.when(r.value.isNotNull(), F.col("_place")))
        return last[r.kind](r.value)

    placed = spread.withColumn("_place", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*by))) if any(r.kind == "last" for r in running.values()) else spread
    sums = placed.groupBy(*keys, "_part").agg(*[total(r).alias(f"_carry_{n}") for n, r in running.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), *[r.over_parts(F.col(f"_carry_{n}"), before).alias(f"_carry_{n}") for n, r in running.items()])
    local = rows.withColumns({n: r.local(w) for n, r in running.items()})
    met = local.join(F.broadcast(carries), on & (F.col("_part") == F.col("_p")), "left")
    return met.withColumns({n: r.joined(F.col(f"_carry_{n}"), F.col(n)) for n, r in running.items()}).select(*df.columns, *running)


def asof_scan(df: DataFrame, keys: list[str], order: list[str], value: Column, matches: Column, name: str, forward: bool = False, part_rows: int = 1_000_000) -> DataFrame:
    """df with the value at the nearest matching row of the key, at or before each row, or after it."""
    by = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
    return scan(df, keys, by, {name: Running("last", F.when(matches, value))}, part_rows)
