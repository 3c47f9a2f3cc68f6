"""What the corpus operators share: word rules, the shared folder, code shipping."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_staged, new_folder, shared_root, ship_code, stage

__all__ = ["SEPARATORS", "drop_staged", "n_words", "new_folder", "shared_root", "ship", "stage", "words"]

#: Separators of words: space and U+0009 to U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"
ARROW_ROWS = 2000


def words(text: Column) -> Column:
    """Array of the maximal runs of non-separators; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and lower the session's rows to an Arrow batch to ARROW_ROWS.

    A batch of texts is held by the JVM and by Python at once.
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:  # 0 and below: no limit
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_code(spark)
