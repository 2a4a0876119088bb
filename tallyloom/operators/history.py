"""History of changing entity attributes (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.ordered import merge_versions, valid_text
from tallyloom.session import table


def attribute_history(changes: list[DataFrame], keys: list[str], time: str, value: str, partitions: int | None = None) -> DataFrame:
    """Versions with a value, each with the period in which it was valid.

    Values are compared and given trimmed and in lower case; a null or blank value clears. Result:
    the keys, `version_value`, `valid_from_us`, `valid_to_us` (-1 while open), in microseconds since
    1970. Rows with a null key or time are left out; of rows of one key and time the greatest value
    counts; repeated rows change nothing; empty tables give no rows; other columns are ignored.
    """
    cleaned = [c.select(*keys, time, valid_text(F.col(value)).alias("__value")) for c in changes]
    v = merge_versions(cleaned, keys, time, "__value", partitions=partitions)
    return v.where("value is not null").select(*keys, F.col("value").alias("version_value"), F.col("valid_from").alias("valid_from_us"), F.coalesce("valid_to", F.lit(-1).cast("bigint")).alias("valid_to_us"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "collective_membership_changes")
    return attribute_history([changes], ["membership_id", "field"], "observed_at", "new_value")


P7_SQL = r"""
WITH r AS (
  SELECT DISTINCT membership_id, field, observed_at AS t,
         nullif(lower(regexp_replace(new_value, '^\s+|\s+$', '', 'g')), '') AS v
  FROM collective_membership_changes
  WHERE membership_id IS NOT NULL AND field IS NOT NULL AND observed_at IS NOT NULL
), one AS (
  SELECT membership_id, field, t, max(v) AS v FROM r GROUP BY ALL
), p AS (
  SELECT *, lag(v) OVER w AS pv, row_number() OVER w AS n FROM one
  WINDOW w AS (PARTITION BY membership_id, field ORDER BY t)
), c AS (
  SELECT * FROM p WHERE n = 1 OR v IS DISTINCT FROM pv
), e AS (
  SELECT *, lead(t) OVER (PARTITION BY membership_id, field ORDER BY t) AS t1 FROM c
)
SELECT membership_id, field, v AS version_value, epoch_us(t) AS valid_from_us,
       coalesce(epoch_us(t1), -1) AS valid_to_us
FROM e WHERE v IS NOT NULL
"""
