"""Parquet tables of one data directory, read with exactly the nested fields that a query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Nested readers: Parquet clips a struct to the fields that are asked for, so a narrow schema is a narrow scan.
TEXT_BLOCKS = "blocks array<struct<kind:string,level:int,marker:string,spans:array<struct<text:string,link:int,image:boolean>>,cell_rows:array<array<array<struct<text:string>>>>,caption:boolean>>"
FULL_SPAN = "struct<text:string,link:int,bold:boolean,code:boolean,image:boolean,italic:boolean,strike:boolean,minor:boolean,translated:boolean,src:string>"
FULL_BLOCKS = f"blocks array<struct<kind:string,spans:array<{FULL_SPAN}>,level:int,marker:string,cell_rows:array<array<array<{FULL_SPAN}>>>,anchors:array<string>,caption:boolean,translation:boolean>>"


def table(spark: SparkSession, data_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """One table; ``schema`` (DDL) limits the scan to those columns and nested fields."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{data_dir}/{name}.parquet")
