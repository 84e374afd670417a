"""Ingestion of a stream of calls into several tables, each call once.

A micro-batch writes its part of every table into a folder named by the batch,
and its number into a ledger when all of them are there. Readers take the
batches of the ledger only. A batch that runs again, after a crash between two
tables or after it was complete, writes the same folders again, so nothing is
there twice or halfway.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder

#: What of a batch goes into a table: (batch, what earlier batches have put there).
Part = Callable[[DataFrame, DataFrame], DataFrame]


class Ingestion:
    def __init__(self, spark: SparkSession, tables: dict[str, tuple[str, Part]], path: str | None = None) -> None:
        """tables: name to (schema, part); ``path`` is where an ingestion was
        begun before, else a new folder of the shared one."""
        self.spark, self.tables, self.path = spark, tables, path or shared_folder(spark, "ingested")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> list[int]:
        """Numbers of the complete batches."""
        if not self.fs.exists(self._at("ledger")):
            return []
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(self._at("ledger")) if s.getPath().getName().isdigit())

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """A table as of the complete batches, or of those before one."""
        done = [b for b in self.batches() if before is None or b < before]
        schema = self.tables[table][0]
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{table}/{b}" for b in done])

    def take(self, df: DataFrame, batch: int) -> None:
        """One micro-batch; a complete one is left as it is."""
        if batch in self.batches():
            return
        for name, (_, part) in self.tables.items():
            part(df, self.read(name, batch)).write.mode("overwrite").parquet(f"{self.path}/{name}/{batch}")
        self.fs.create(self._at(f"ledger/{batch}"), True).close()

    def run(self, stream: DataFrame) -> None:
        """Takes all that the stream has now."""
        query = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        query.awaitTermination()


HISTORY = "call_id string, database string, tool string, seq long"
TERMINALS = "call_id string, tool string, code string, seq long, status string"
AUDIT = "seq long, call_id string, action string"


def _first(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where("__n = 1").drop("__n")


def history(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The finalized calls that aren't there yet, each by its first row."""
    new = _first(batch.where("kind = 'finalize'"), "call_id")
    return new.join(known.select("call_id"), "call_id", "left_anti").select("call_id", "database", "tool", "seq")


def terminals(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Terminal events with what becomes of each: a call's first one is
    inserted, one that says the same again exists, another is a conflict."""
    own = batch.where("kind = 'terminal'").select("call_id", "tool", "code", "seq")
    there = known.where("status = 'inserted'").select("call_id", F.struct(F.lit(-1).cast("long").alias("seq"), "tool", "code").alias("was"))
    firsts = own.groupBy("call_id").agg(F.min(F.struct("seq", "tool", "code")).alias("was")).unionByName(there).groupBy("call_id").agg(F.min("was").alias("was"))
    met = own.join(firsts, "call_id")
    status = F.when(F.col("was.seq") == F.col("seq"), "inserted").when((F.col("was.tool") == F.col("tool")) & (F.col("was.code") == F.col("code")), "existing").otherwise("conflict")
    return met.select("call_id", "tool", "code", "seq", status.alias("status"))


def audit(batch: DataFrame, known: DataFrame) -> DataFrame:
    """An entry for each row; a row that comes again has one already."""
    return _first(batch.select("seq", "call_id", F.col("kind").alias("action")), "seq").join(known.select("seq"), "seq", "left_anti").select("seq", "call_id", "action")


TABLES = {"history": (HISTORY, history), "terminals": (TERMINALS, terminals), "audit": (AUDIT, audit)}
