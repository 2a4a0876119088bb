"""Snapshots of tables, saved reports, and the export of whole tables.

A table is a folder of snapshots and numbered pointer files, each naming the snapshots of one state;
the highest number is the current state. A write makes a snapshot and then puts the next pointer in
place by one rename, so that a run that fails at any point leaves the old state, and a running reader
keeps its files. An append writes the new rows only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables under one root path, one root an instance."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self, table: str) -> list[str]:
        """Names of the table's pointer files, oldest first."""
        fs, p = self._fs(f"{self.root}/{table}")
        return sorted(n for f in fs.listStatus(p) if (n := f.getPath().getName()).startswith("state-")) if fs.exists(p) else []

    def _snapshots(self, table: str) -> list[str] | None:
        """The current state's snapshots; None for no table."""
        at = self._pointers(table)
        return [r[0] for r in self.spark.read.text(f"{self.root}/{table}/{at[-1]}").collect()] if at else None

    def _turn(self, table: str, snapshots: list[str], keep: int = 2) -> None:
        old = self._pointers(table)
        number = int(old[-1].split("-")[1]) + 1 if old else 0
        name = f"state-{number:012d}-{snapshots[-1]}"
        fs, draft = self._fs(f"{self.root}/{table}/.draft-{snapshots[-1]}")
        out = fs.create(draft, True)
        out.write("\n".join(snapshots).encode())
        out.close()
        if not fs.rename(draft, self._fs(f"{self.root}/{table}/{name}")[1]):
            raise OSError(f"{table}: the new state could not be put in place")
        for n in old[:-keep]:
            fs.delete(self._fs(f"{self.root}/{table}/{n}")[1], False)

    def _snapshot(self, table: str, df: DataFrame) -> tuple[str, int]:
        name, seen = f"v-{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{table}/{name}")
        return name, seen.get["n"]

    def tables(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def read(self, table: str) -> DataFrame:
        at = self._snapshots(table)
        if at is None:
            raise KeyError(table)
        parts = [self.spark.read.parquet(f"{self.root}/{table}/{n}") for n in at]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def write(self, table: str, df: DataFrame) -> int:
        """Make `df` the table's current state; the number of its rows, counted while it is written."""
        name, n = self._snapshot(table, df)
        self._turn(table, [name])
        return n

    def append(self, table: str, df: DataFrame) -> int:
        """Add rows to the table, of which only they are written; the number of the table's rows."""
        name, _ = self._snapshot(table, df)
        self._turn(table, [*(self._snapshots(table) or []), name])
        return self.read(table).count()


def run_report(spark: SparkSession, store: Store, name: str, ran_by: str, at: str, output: str | None = None) -> DataFrame:
    """Run a saved report (its view, else its SQL) over the store's tables and add the run to the ledger; archived reports run as well."""
    row = store.read("saved_reports").where(F.col("name") == name).first()
    if row is None:
        raise KeyError(f"no report named {name!r}")
    for t in store.tables():
        if t not in ("saved_reports", "saved_report_runs"):
            store.read(t).createOrReplaceTempView(t)
    df = spark.table(row["view_name"]) if row["view_name"] else spark.sql(row["sql_query"])
    if output:
        from tallyloom.sources.files import write_csv

        seen = Observation()
        write_csv(df.observe(seen, F.count(F.lit(1)).alias("n")), output)
        n = seen.get["n"]
    else:
        n = df.count()
    run = spark.createDataFrame([(name, n, output, ran_by, at)], "report string, row_count bigint, output_path string, ran_by string, ran_at string")
    store.append("saved_report_runs", run)
    return df


def as_json_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row: every row of every table as JSON."""
    return reduce(DataFrame.unionAll, [df.select(F.lit(t).alias("table_name"), F.to_json(F.struct("*")).alias("row")) for t, df in tables.items()])


def status_matrix(applied: DataFrame, item: str, where: str, instances: list[str]) -> DataFrame:
    """One row an item, one column an instance: whether it was applied there."""
    return applied.groupBy(item).pivot(where, instances).agg(F.count(F.lit(1))).select(item, *[(F.coalesce(F.col(i), F.lit(0)) > 0).alias(i) for i in instances])
