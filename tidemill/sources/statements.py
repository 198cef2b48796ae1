"""CREATE, TRUNCATE, DROP, ANALYZE and EXPLAIN by Spark's catalogue."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def create_table_as(df: DataFrame, name: str, *, unique: bool = True) -> str:
    """CREATE TABLE AS SELECT, as Parquet in the warehouse. unique: a name of this call's own, which is returned."""
    name = f"{name}_{uuid.uuid4().hex}" if unique else name
    df.write.format("parquet").saveAsTable(name)
    return name


def truncate_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def column_statistics(spark: SparkSession, name: str, column: str) -> DataFrame:
    """ANALYZE TABLE ... FOR COLUMNS, then what the catalogue knows: column, distinct_values, nulls, low, high."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {column}")
    facts = spark.sql(f"DESCRIBE EXTENDED {name} {column}")

    def fact(label: str):
        return F.max(F.when(F.col("info_name") == label, F.col("info_value")))

    return facts.agg(F.lit(column).alias("column"), fact("distinct_count").cast("long").alias("distinct_values"), fact("num_nulls").cast("long").alias("nulls"), fact("min").alias("low"), fact("max").alias("high"))


def explain(df: DataFrame) -> str:
    """The formatted plan, expression numbers left out."""
    view = f"explained_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        text = df.sparkSession.sql(f"EXPLAIN FORMATTED SELECT * FROM {view}").first()[0]
    finally:
        df.sparkSession.catalog.dropTempView(view)
    return re.sub(r"#\d+L?", "", text)
