"""Logical table catalog: logical name -> DataFrame.

The report code never reads files itself; it asks a catalog for a logical
table (``fact_orders``, ``dim_partner``, ...). Three ways to fill one:

* ``ParquetCatalog``  production: one Parquet dataset per logical table, read
  with the explicit schema of ``schemas.py`` (filters and nested-column
  pruning reach the scan);
* ``driver_catalog``  (``tpch_adapter``) derives the logical tables from the
  driver's TPC-H-like tables with DataFrame expressions;
* ``frames_catalog``  small in-memory tables for golden tests.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .schemas import LOGICAL_SCHEMAS


class Catalog:
    def __init__(self, spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._builders = dict(builders)
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in self._builders:
                raise KeyError(f"catalog has no table {name!r}")
            self._frames[name] = self._builders[name]()
        return self._frames[name]

    __getitem__ = table

    def optional(self, name: str) -> DataFrame | None:
        """The table, or None where the source has none."""
        try:
            return self.table(name)
        except (KeyError, AnalysisException):
            return None

    def memo(self, key, build: Callable[[], DataFrame]) -> DataFrame:
        """A DataFrame derived from the catalog, built once per catalog (plans only, no data)."""
        if key not in self._frames:
            self._frames[key] = build()
        return self._frames[key]

    def with_tables(self, **tables: DataFrame) -> "Catalog":
        """The same catalog with some tables replaced."""
        return Catalog(self.spark, {**self._builders, **{n: (lambda df=df: df) for n, df in tables.items()}})

    def names(self) -> list[str]:
        return sorted(self._builders)


class ParquetCatalog(Catalog):
    """``{root}/{logical_name}`` Parquet datasets read with explicit schemas.

    A fact that is partitioned by ``registered_month`` (first day of the month)
    has that column too, and date ranges then also prune its folders.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root = root
        builders = {
            name: (lambda name=name, schema=schema:
                   spark.read.schema(schema).parquet(f"{root}/{name}"))
            for name, schema in LOGICAL_SCHEMAS.items()
        }
        super().__init__(spark, builders)


def frames_catalog(spark: SparkSession, rows: Mapping[str, list]) -> Catalog:
    """Catalog over literal rows, one list per logical table; missing tables are empty."""
    builders = {
        name: (lambda name=name, schema=schema:
               spark.createDataFrame(rows.get(name, []), schema=schema))
        for name, schema in LOGICAL_SCHEMAS.items()
    }
    return Catalog(spark, builders)
