"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which every executor sees. Where that is unset, local masters (tests) get a folder of our own; a cluster is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="geotally-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark's own setting by which a finished write drops the shuffle files it needed.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders written inside each open passing() block, the innermost last.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that saved() writes in this block, lasting ones apart, are deleted at its end: nothing after it may read them."""
    mine: list[str] = []
    token = _written.set((*_written.get(), mine))
    try:
        yield
    finally:
        _written.reset(token)
        for folder in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, lasting: bool = False) -> DataFrame:
    """df, written to the shared folder and read again: later steps start there and lost executors cost nothing that was done.

    The write's shuffle files go with it, so steps don't pile up on the executors' disks. The table itself goes at the end of
    the passing() block, if there is one; a lasting one stays until the end of the block around that.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    path, blocks = shared_folder(spark), _written.get()
    if len(blocks) > lasting:
        blocks[-1 - lasting].append(path)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id, as long, and the whole text, null as empty: other columns and their names don't matter after this."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
