"""Groups of records over shared identifiers (G12), as labels that travel along the identifiers.

Records are never paired with one another: a record knows its identifiers, an identifier the least
label of its records. Each round takes that label over and follows it one step further (the label
of the label), so that chains shorten quickly; rounds end when no label moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.lineage import cut


def shared_key_groups(rows: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """`record`, `group_id`: each record with the smallest record it is tied to by an equal identifier, directly or through others.

    Identifiers of different columns never meet. Null and empty identifiers tie nothing; a record
    without any is its own group, rows with a null record are left out. Repeated rows change nothing.
    """
    own = rows.where(F.col(record).isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys]))
    ties = cut(own.select(F.col(record).alias("r"), each.alias("e")).select("r", "e.*").where("value <> ''").distinct(), "ties").df
    label = cut(ties.select("r").distinct().select("r", F.col("r").alias("g"), F.lit(True).alias("moved")), "labels")
    while not label.df.where("moved").isEmpty():
        least = ties.join(label.df.select("r", "g"), "r").groupBy("kind", "value").agg(F.min("g").alias("g"))
        told = ties.join(least, ["kind", "value"]).groupBy("r").agg(F.min("g").alias("told"))
        far = label.df.select(F.col("r").alias("told"), F.col("g").alias("far"))
        new = told.join(far, "told").select("r", F.least("told", "far").alias("new")).join(label.df.select("r", "g"), "r")
        after = cut(new.select("r", F.col("new").alias("g"), (F.col("new") != F.col("g")).alias("moved")), "labels")
        label.drop()
        label = after
    tied = label.df.select("r", "g")
    return own.select(F.col(record).alias("r")).distinct().join(tied, "r", "left").select(F.col("r").alias(record), F.coalesce("g", "r").alias("group_id"))
