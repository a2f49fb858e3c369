"""Station dimension: a headed CSV file whose first column is an unnamed row index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STATIONS_DDL


def load_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations in file order; none if the file is missing."""
    try:
        return (spark.read.schema(STATIONS_DDL).option("header", True).option("enforceSchema", True)
                .csv(path).filter(F.col("station").isNotNull()))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATIONS_DDL)


def within(stations: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Stations inside a box; for files that hold a few stations of another state."""
    return stations.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
