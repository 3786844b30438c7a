"""Arrow batches of few rows, for stages whose rows are whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 512
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with at most ``ROWS`` rows in a batch.

    Spark's default of 10 000 rows is meant for numbers; with whole texts a
    batch, its copy in the JVM and what is made of it in Python would hold
    hundreds of MB per task. The setting is the session's and stays lowered.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_KEY)) <= ROWS:
        conf.set(_KEY, str(ROWS))
    return df.mapInArrow(run, schema)
