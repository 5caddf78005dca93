"""Holiday lists and declared closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_closures(spark: SparkSession, path: str) -> DataFrame:
    """Closure CSV with `date,description`."""
    return closure_rows(spark.read.option("header", True).csv(path))


def closure_rows(rows: DataFrame) -> DataFrame:
    note = F.trim(F.coalesce("description", F.lit("")))
    return rows.withColumns(
        {
            "date": F.to_date(F.trim("date")),
            "source": F.when(note != "", F.concat(F.lit("customer_upload:"), note)).otherwise("customer_upload"),
        }
    ).drop("description")


def holidays_of(holidays: DataFrame, country: str, year: int) -> DataFrame:
    """Rows of one country and year from a static holiday table (country, date, name)."""
    return holidays.filter((F.col("country") == country) & (F.year("date") == year)).select(
        "date", F.concat(F.lit(f"holiday_api:{country}:"), F.col("name")).alias("source")
    )
