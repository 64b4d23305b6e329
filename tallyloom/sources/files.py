"""Files in and out: CSV, Parquet, JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import SALES_SCHEMA

# Columns of the dashboard export.
EXPORT_COLUMNS = ["timestamp", "transaction_id", "product_name", "category", "region", "quantity",
                  "unit_price", "total_amount"]


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet", schema=SALES_SCHEMA,
                      by_month: bool = False) -> DataFrame:
    """Transactions of a declared schema; ``by_month`` adds the folder column of ``write_table``."""
    reader = spark.read.schema(StructType([*schema.fields, StructField("month", StringType())]) if by_month else schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def load_tail(df: DataFrame, buffer_size: int = 10_000) -> DataFrame:
    """The newest ``buffer_size`` rows: a bounded buffer over a history of any length."""
    return df.orderBy(F.desc("timestamp"), F.desc("transaction_id")).limit(buffer_size)


def add_transactions(spark: SparkSession, rows: list[dict] | DataFrame, landing: str, schema=SALES_SCHEMA) -> None:
    """Append records, or a frame of them, to the landing table that the file stream reads."""
    frame = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schema)
    frame.write.mode("append").parquet(landing)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_table(df: DataFrame, path: str, mode: str = "error", partition: str | None = "month") -> str:
    """Parquet, split by month of ``timestamp`` so that date filters prune folders."""
    if partition == "month" and "timestamp" in df.columns:
        df = df.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
        df.write.mode(mode).partitionBy("month").parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def export_projection(df: DataFrame) -> DataFrame:
    """The eight export columns as text, with empty text for null and zero."""
    def cell(name: str):
        text = F.col(name).cast("string")
        numeric = dict(df.dtypes)[name] not in ("string", "timestamp")
        blank = F.col(name).isNull() | (F.col(name) == 0) if numeric else F.col(name).isNull()
        return F.when(blank, "").otherwise(text).alias(name)
    return df.select(*[cell(c) for c in EXPORT_COLUMNS])


def export_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    export_projection(df).write.mode(mode).option("header", True).option("quoteAll", True).csv(path)
    return path


def to_records(df: DataFrame) -> DataFrame:
    """One JSON text per row: ISO timestamps, null for missing and not-a-number."""
    cols = [F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c)
            if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
    return df.select(F.to_json(F.struct(*cols), options).alias("record"))
