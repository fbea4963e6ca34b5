"""Relations with two back ends.

An operator is written once against ``Rel``. On ``SparkRel`` every step is a
DataFrame transformation, so Catalyst sees one declarative plan; on ``DuckRel`` the
same steps become a chain of common table expressions, which DuckDB runs as the
correctness oracle. Expressions are SQL text of the common subset, or come from
``Dialect`` where the engines differ.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


@dataclass(frozen=True)
class Dialect:
    name: str

    def text(self, sql) -> str:
        """SQL whose plain decimal literals are doubles, which neither engine takes them for."""
        return _DECIMAL.sub(r"\1D" if self.spark else r"\1e0", str(sql))

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def xor(self, a, b) -> str:
        return f"(({a}) ^ ({b}))" if self.spark else f"xor({a}, {b})"

    def div(self, a, b) -> str:
        """Integer division of non-negative integers."""
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def rint(self, x) -> str:
        """To the nearest integer, ties to even; a double."""
        return f"rint({x})" if self.spark else f"round_even({x}, 0)"

    def ints(self, low, high) -> str:
        """An array of all integers from low to high."""
        return f"sequence({low}, {high})" if self.spark else f"generate_series({low}, {high})"

    def array(self, values) -> str:
        items = ", ".join(map(str, values))
        return f"array({items})" if self.spark else f"[{items}]"

    def at(self, array, index) -> str:
        """The element at an index from 0."""
        return f"element_at({array}, cast({index} as int) + 1)" if self.spark else f"({array})[cast({index} as int) + 1]"

    def any(self, condition) -> str:
        return f"bool_or({condition})"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def whole(x) -> str:
    """floor as an integer."""
    return f"cast(floor({x}) as bigint)"


def num(x: float) -> str:
    """A double literal both engines read alike."""
    return f"cast({float(x)!r} as double)"


class Rel:
    """Columns in order; every step gives a new relation."""

    d: Dialect
    columns: list[str]

    def let(self, **e: str) -> Rel:
        raise NotImplementedError

    def keep(self, *columns: str) -> Rel:
        raise NotImplementedError

    def where(self, condition: str) -> Rel:
        raise NotImplementedError

    def join(self, other: Rel, on: list[str], how: str = "inner") -> Rel:
        raise NotImplementedError

    def group(self, keys: list[str], **e: str) -> Rel:
        raise NotImplementedError

    def explode(self, name: str, array: str) -> Rel:
        raise NotImplementedError

    def union(self, other: Rel) -> Rel:
        raise NotImplementedError

    def drop(self, *columns: str) -> Rel:
        return self.keep(*[c for c in self.columns if c not in columns])


@dataclass
class SparkRel(Rel):
    df: DataFrame
    d: Dialect = SPARK

    @property
    def columns(self):
        return self.df.columns

    def let(self, **e):
        return SparkRel(self.df.withColumns({k: F.expr(SPARK.text(v)) for k, v in e.items()}))

    def keep(self, *columns):
        return SparkRel(self.df.select(*columns))

    def where(self, condition):
        return SparkRel(self.df.where(SPARK.text(condition)))

    def join(self, other, on, how="inner"):
        return SparkRel(self.df.join(other.df, on, how))

    def group(self, keys, **e):
        return SparkRel(self.df.groupBy(*keys).agg(*[F.expr(SPARK.text(v)).alias(k) for k, v in e.items()]))

    def explode(self, name, array):
        return SparkRel(self.df.select("*", F.explode(F.expr(SPARK.text(array))).alias(name)))

    def union(self, other):
        return SparkRel(self.df.unionByName(other.df))


_names = itertools.count()


@dataclass
class DuckRel(Rel):
    steps: tuple[tuple[str, str], ...]
    columns: list[str]
    d: Dialect = field(default=DUCK)

    def _next(self, sql: str, columns: list[str], more: tuple = ()) -> DuckRel:
        known = {n for n, _ in self.steps}
        return DuckRel((*self.steps, *[s for s in more if s[0] not in known], (f"s{next(_names)}", DUCK.text(sql))), columns)

    @property
    def name(self) -> str:
        return self.steps[-1][0]

    def let(self, **e):
        old = [f"{e[c]} as {c}" if c in e else c for c in self.columns]
        new = [f"{v} as {k}" for k, v in e.items() if k not in self.columns]
        return self._next(f"select {', '.join(old + new)} from {self.name}", [*self.columns, *[k for k in e if k not in self.columns]])

    def keep(self, *columns):
        return self._next(f"select {', '.join(columns)} from {self.name}", list(columns))

    def where(self, condition):
        return self._next(f"select * from {self.name} where {condition}", self.columns)

    def join(self, other, on, how="inner"):
        columns = [*on, *[c for c in self.columns if c not in on], *[c for c in other.columns if c not in on]]
        return self._next(
            f"select {', '.join(columns)} from {self.name} {how} join {other.name} using ({', '.join(on)})", columns, other.steps
        )

    def group(self, keys, **e):
        picked = [*keys, *[f"{v} as {k}" for k, v in e.items()]]
        by = f" group by {', '.join(keys)}" if keys else ""
        return self._next(f"select {', '.join(picked)} from {self.name}{by}", [*keys, *e])

    def explode(self, name, array):
        return self._next(f"select *, unnest({array}) as {name} from {self.name}", [*self.columns, name])

    def union(self, other):
        columns = ", ".join(self.columns)
        return self._next(f"select {columns} from {self.name} union all select {columns} from {other.name}", self.columns, other.steps)

    def sql(self) -> str:
        steps = ",\n".join(f"{n} as ({s})" for n, s in self.steps)
        return f"with {steps}\nselect * from {self.name}"


class Spark:
    """Opens tables of a folder as ``SparkRel``."""

    d = SPARK

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str, *columns: str) -> SparkRel:
        return SparkRel(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").selectExpr(*columns))

    def ints(self, name: str, n: int) -> SparkRel:
        return SparkRel(self.spark.range(n).withColumnRenamed("id", name))

    def values(self, columns: list[str], rows: list[tuple]) -> SparkRel:
        kinds = ["bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string" for v in rows[0]]
        # a constant: broadcast, as its few keys would leave a shuffle's tasks uneven
        return SparkRel(F.broadcast(self.spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds, strict=True)))))


class Duck:
    """Opens the same tables as ``DuckRel``."""

    d = DUCK

    def table(self, name: str, *columns: str) -> DuckRel:
        return DuckRel(((f"s{next(_names)}", f"select {', '.join(columns)} from {name}"),), [c.split(" as ")[-1] for c in columns])

    def ints(self, name: str, n: int) -> DuckRel:
        return DuckRel(((f"s{next(_names)}", f"select range as {name} from range({n})"),), [name])

    def values(self, columns: list[str], rows: list[tuple]) -> DuckRel:
        def literal(v):
            return f"cast({v} as bigint)" if isinstance(v, int) else num(v) if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"

        text = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
        return DuckRel(((f"s{next(_names)}", f"select * from (values {text}) v({', '.join(columns)})"),), list(columns))
