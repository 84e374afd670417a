"""Sessions and what their Python workers need."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def packed() -> str:
    """This package as a zip file in a local folder of the driver."""
    path = Path(tempfile.mkdtemp(prefix="veilspark-")) / "veilspark.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            out.write(source, source.relative_to(ROOT))
    return str(path)


def with_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, wherever they run: the driver
    sends it to them, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        context.addPyFile(packed())
        _sent.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local one
    is used only where it is unset and the master is this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        at = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: steps of a loop
    start from a table, not from all steps before."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: both sides are
    shuffled and sorted, neither goes whole through the driver. Spark takes
    tables of short texts for what their files hold and would broadcast ones
    that are some fifty times larger in memory."""
    return df.hint("merge")


#: Bits of monotonically_increasing_id() that number the rows of a partition.
_IN_PARTITION = 33


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with ``name``, their position from 1 in ``order`` over all
    partitions: each sorts a range of its own, and starts after what those
    before it hold. Rows that ``order`` leaves equal have either's position."""
    # ranges are drawn from a sample, so what is sorted is a table
    at = written(written(rows, "rows").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    at = at.withColumns({"__part": F.shiftright("__at", _IN_PARTITION), "__at": F.col("__at").bitwiseAND((1 << _IN_PARTITION) - 1) + 1})
    # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = at.groupBy("__part").agg(F.count("*").alias("n")).select("__part", before.alias("__before"))
    return at.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__at") + F.col("__before")).cast("int")).drop("__at", "__part", "__before")
