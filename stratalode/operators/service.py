"""What a service in front of the catalogue asks for: its health, the status of a failure, whole lists by pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .versions import VersionConflict


class Unprocessable(ValueError):
    """The request is well formed, its content can't be handled."""


# The first kind that an error is of gives the status.
STATUSES = ((Unprocessable, 422), (VersionConflict, 409), (LookupError, 404), (PermissionError, 401), (ValueError, 400), (AnalysisException, 400))


def status_of(error: Exception) -> int:
    """HTTP status of a failure; 500 of what isn't known."""
    return next((status for kind, status in STATUSES if isinstance(error, kind)), 500)


def health(spark: SparkSession) -> DataFrame:
    """(status, version): UP, and the engine's version, as the engine tells it."""
    return spark.sql("SELECT version() AS version").select(F.when(F.col("version") != "", "UP").otherwise("DOWN").alias("status"), "version")


def paged(rows: DataFrame, order: list, size: int = 200, most: int = 500) -> DataFrame:
    """The pages of a list up to the first short one, at most so many: one sorted read, not one a page."""
    return rows.orderBy(*order).limit(size * most)
