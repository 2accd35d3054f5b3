"""Packs: small files as rows ``(path, value)`` of Parquet files.

A file each costs a create, a rename, a listing entry on the driver and a read request, so trees of many small files are kept packed: the number of real files
then follows the bytes. Readers of folders have a twin that takes such rows; paths have the form they have in the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACK = "path STRING, value STRING"


def write_pack(files: DataFrame, root: str) -> None:
    files.select("path", "value").write.parquet(root)


def read_pack(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(PACK).parquet(root)
