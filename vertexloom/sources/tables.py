"""Where a graph's tables come from."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_utc(rows: DataFrame) -> DataFrame:
    """Times without a zone as instants, read as UTC whatever the session's zone; so they have a
    canonical form in responses."""
    zoned = {f.name: F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(f"`{f.name}`")).cast("timestamp") for f in rows.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return rows.withColumns(zoned) if zoned else rows


class Tables:
    """Resolves table names to DataFrames. The session is the caller's; none is made here."""

    def __init__(self, read: Callable[[str], DataFrame]):
        self._read = read
        self._seen: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self._read(name)
        return self._seen[name]

    @classmethod
    def in_directory(cls, spark: SparkSession, path: str, format: str = "parquet", resolve: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Tables:
        """One file or folder for each table, named ``<table>.<format>``; ``resolve`` may cast or
        rename columns, as ``in_utc`` does."""
        return cls(lambda name: resolve(spark.read.format(format).load(f"{path}/{name}.{format}")))

    @classmethod
    def in_catalog(cls, spark: SparkSession, schema: str | None = None) -> Tables:
        """Tables of the session's catalog; a name with a dot names its own schema."""
        return cls(lambda name: spark.table(name if "." in name or not schema else f"{schema}.{name}"))

    @classmethod
    def of(cls, frames: Mapping[str, DataFrame]) -> Tables:
        return cls(frames.__getitem__)
