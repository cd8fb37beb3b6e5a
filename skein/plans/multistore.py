"""SQL across several datasets under aliases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class MultiStore:
    """Datasets attached under aliases: ``alias.table`` in SQL is a view of the dataset's table."""

    def __init__(self, spark: SparkSession):
        self.spark, self._attached = spark, {}

    def __enter__(self) -> MultiStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def connection(self) -> SparkSession:
        return self.spark

    @property
    def datasets(self) -> dict[str, list[str]]:
        return {a: sorted(t) for a, t in self._attached.items()}

    def attach(self, alias: str, tables: dict[str, DataFrame] | str) -> None:
        """Attaches frames by name, or the tables of a database."""
        if not NAME.match(alias):
            raise ValueError(f"{alias!r} is not an identifier")
        if alias in self._attached:
            raise ValueError(f"{alias!r} is attached already")
        if isinstance(tables, str):
            tables = {t.name: self.spark.table(f"{tables}.{t.name}") for t in self.spark.catalog.listTables(tables) if not t.isTemporary}
        for name, df in tables.items():
            df.createOrReplaceTempView(f"{alias}__{name}")
        self._attached[alias] = set(tables)

    def detach(self, alias: str) -> None:
        for name in self._attached.pop(alias):
            self.spark.catalog.dropTempView(f"{alias}__{name}")

    def close(self) -> None:
        for alias in [*self._attached]:
            self.detach(alias)

    def _rewritten(self, sql: str) -> str:
        known = {f"{a}.{t}": f"{a}__{t}" for a, ts in self._attached.items() for t in ts}
        if not known:
            return sql
        names = "|".join(map(re.escape, sorted(known, key=len, reverse=True)))
        # strings are left as they are
        return re.sub(rf"('(?:[^'\\]|\\.|'')*')|(?<![\w.])({names})(?![\w])", lambda m: m[1] or known[m[2]], sql)

    def query(self, sql: str, params: list | None = None) -> DataFrame:
        """Any Spark SQL over the attached tables; ``?`` takes params in order."""
        sql = self._rewritten(sql)
        return self.spark.sql(sql, args=params) if params else self.spark.sql(sql)

    def raw(self, alias: str, sql: str) -> DataFrame:
        """SQL within one dataset, whose tables need no prefix."""
        if alias not in self._attached:
            raise KeyError(alias)
        names = "|".join(map(re.escape, sorted(self._attached[alias], key=len, reverse=True)))
        return self.spark.sql(re.sub(rf"('(?:[^'\\]|\\.|'')*')|\b((?:from|join|,)\s+)({names})\b", lambda m: m[1] or f"{m[2]}{alias}__{m[3]}", sql, flags=re.I))

    def union(self, table: str) -> DataFrame:
        """One table of all datasets, with the alias in _dataset."""
        out = None
        for alias, names in self._attached.items():
            if table in names:
                df = self.spark.table(f"{alias}__{table}").withColumn("_dataset", F.lit(alias))
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise KeyError(table)
        return out
