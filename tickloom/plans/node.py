"""The lazy tick table: one row for each (tick, entity); rows are ticks, NaN is a missing value, null is 'did not tick'."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KINDS = ("array", "series", "unit")
NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal(20,0)"}


@dataclass(frozen=True)
class Node:
    """df has `ts`, the entity columns, and the value columns; init is what readers see before the first tick."""

    df: DataFrame
    ts: str = "ts"
    entity: tuple[str, ...] = ()
    values: tuple[str, ...] = ("v",)
    init: float | None = 0.0
    kind: str = "array"

    def __post_init__(self) -> None:
        missing = [c for c in (self.ts, *self.entity, *self.values) if c not in self.df.columns]
        if missing:
            raise ValueError(f"no column {missing} in {self.df.columns}")
        if self.kind not in KINDS:
            raise TypeError(f"kind must be one of {KINDS}")

    @property
    def v(self) -> str:
        return self.values[0]

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.entity, self.ts)

    def over_time(self) -> WindowSpec:
        return Window.partitionBy(*self.entity).orderBy(self.ts)

    def across(self) -> WindowSpec:
        return Window.partitionBy(self.ts)

    def require(self, kinds: set[str]) -> None:
        """Raises TypeError unless all values have one of the types."""
        types = dict(self.df.dtypes)
        bad = {c: types[c] for c in self.values if types[c] not in kinds}
        if bad:
            raise TypeError(f"not allowed here: {bad}")

    def with_df(self, df: DataFrame, **changes) -> Node:
        return replace(self, df=df, **changes)

    def derive(self, value: Column, init: float | None = 0.0, name: str | None = None) -> Node:
        """The node of one value computed from each row."""
        name = name or self.v
        return replace(self, df=self.df.select(*self.keys, value.alias(name)), values=(name,), init=init)

    def renamed(self, *names: str) -> Node:
        return replace(self, df=self.df.select(*self.keys, *[F.col(a).alias(b) for a, b in zip(self.values, names, strict=True)]), values=names)

    # result access
    def latest(self) -> DataFrame:
        """The final snapshot: each entity's last values."""
        s = F.struct(*self.values)
        out = self.df.groupBy(*self.entity).agg(F.max_by(s, self.ts).alias("_s"))
        return out.select(*self.entity, "_s.*")

    def history(self) -> DataFrame:
        return self.df.orderBy(*self.keys)

    def last_timestamp(self) -> DataFrame:
        return self.df.agg(F.max(self.ts).alias(self.ts))

    def _numbered(self) -> DataFrame:
        return self.df.withColumn("_n", F.row_number().over(self.over_time()) - 1)

    def at(self, i: int) -> DataFrame:
        """Each entity's i-th row from 0; a negative i counts from the end."""
        if i >= 0:
            return self._numbered().where(F.col("_n") == i).drop("_n")
        back = Window.partitionBy(*self.entity).orderBy(F.col(self.ts).desc())
        return self.df.withColumn("_n", F.row_number().over(back)).where(F.col("_n") == -i).drop("_n")

    def slice(self, start: int = 0, end: int | None = None) -> DataFrame:
        """Rows start to end, positions counted from 0 in each entity's history."""
        rows = self._numbered().where(F.col("_n") >= start)
        return (rows if end is None else rows.where(F.col("_n") < end)).drop("_n")

    def tail(self, n: int) -> DataFrame:
        back = Window.partitionBy(*self.entity).orderBy(F.col(self.ts).desc())
        return self.df.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n")

    def asof(self, ts) -> DataFrame:
        """Each entity's last row at or before ts."""
        return self.with_df(self.df.where(F.col(self.ts) <= F.lit(ts))).latest()

    def search(self, ts) -> DataFrame:
        """The position of each entity's first row at or after ts."""
        return self.df.groupBy(*self.entity).agg(F.count(F.when(F.col(self.ts) < F.lit(ts), 1)).alias("position"))

    def to_pandas(self):
        """The history as pandas, entities as columns if there is one entity column."""
        pdf = self.history().toPandas()
        return pdf.pivot(index=self.ts, columns=self.entity[0], values=self.v) if len(self.entity) == 1 and len(self.values) == 1 else pdf
