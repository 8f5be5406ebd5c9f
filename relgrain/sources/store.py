"""Keeping and getting back intermediate results: files under a root, or tables of a catalog."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The schemes of the file systems that a root can name.
SCHEMES = {"local": "file://", "s3": "s3a://", "gcs": "gs://", "blob": "abfss://", "hdfs": "hdfs://", "databricks": "dbfs:"}


@dataclass(frozen=True)
class Store:
    root: str
    provider: str | None = None
    format: str = "parquet"

    def path(self, name: str) -> str:
        """Where ``name`` is kept. A root with a scheme of its own, or without a provider, stays as it is."""
        if self.provider is None or ":" in self.root.split("/")[0]:
            return f"{self.root.rstrip('/')}/{name}"
        if self.provider not in SCHEMES:
            raise ValueError(f"unknown provider {self.provider!r}; known are {', '.join(SCHEMES)}")
        start = SCHEMES[self.provider]
        root = self.root if self.provider in ("local", "databricks") else self.root.lstrip("/")
        return f"{start}{root.rstrip('/')}/{name}"

    def _format(self) -> tuple[str, dict[str, object]]:
        return ("csv", {"header": True, "sep": "\t"}) if self.format == "tsv" else (self.format, {"header": True} if self.format == "csv" else {})

    def write(self, df: DataFrame, name: str) -> str:
        kind, options = self._format()
        df.write.mode("overwrite").format(kind).options(**options).save(self.path(name))
        return self.path(name)

    def read(self, spark: SparkSession, name: str, schema: StructType | str | None = None) -> DataFrame:
        kind, options = self._format()
        reader = spark.read.format(kind).options(**options)
        return (reader.schema(schema) if schema else reader).load(self.path(name))

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read again: the lineage ends here, and the copy is where all executors can read it."""
        self.write(df, name)
        return self.read(df.sparkSession, name, df.schema if self.format in ("csv", "tsv", "json") else None)


def replace_table(df: DataFrame, name: str, format: str = "parquet", root: str | None = None, keep: int = 1) -> DataFrame:
    """Give a name of the session's catalog new rows, without a moment at which it names nothing.

    Each version is written to a folder of its own under ``root`` (default: the warehouse). Then the name, a permanent
    view over the folder, is replaced, which the catalog does in one step: readers get the old rows whole or the new
    ones whole, and after a crash the name still has the old ones. Of the versions before, ``keep`` stay, for readers
    that are still at them. A name that is a table already is an error.
    """
    spark = df.sparkSession
    base = f"{(root or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}.versions"
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        raise ValueError(f"{name} is a table; only names made by this function can be replaced")
    path = f"{base}/{time.time_ns():020d}"
    df.write.format(format).save(path)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {format}.`{path}`")
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for old in sorted(str(x.getPath()) for x in files.listStatus(folder))[: -1 - keep]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    return spark.table(name)
