"""Helpers that the training-data operators share: shared storage, lineage cuts,
checked broadcasts and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a saved table is broadcast; beyond them the join is shuffled.
BROADCAST_BYTES = 32_000_000


#: The folders made in the innermost scratch().
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset,
    a temporary folder is made in local mode; on a cluster this is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = Path(tempfile.mkdtemp(prefix="pairloom-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _path(spark: SparkSession, name: str):
    """A path and its file system, as the JVM has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one; it goes when the application ends."""
    path, files = _path(spark, f"{shared_root(spark)}/pairloom-{uuid.uuid4().hex}")
    files.deleteOnExit(path)
    if (made := _MADE.get()) is not None:
        made.append(path.toString())
    return path.toString()


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a folder of its own and read it back.  This cuts the lineage and
    survives lost executors."""
    path = f"{folder(df.sparkSession)}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing holds any more; it does so
    as the driver collects garbage, which a quiet driver seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete the files of saved tables that no later result reads."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path, files = _path(df.sparkSession, name)
            files.delete(path, True)
    release(tables[0].sparkSession)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end what was saved inside, but for what the tables read that were put
    into the list."""
    made: list[str] = []
    outer, token = _MADE.get(), _MADE.set(made)
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        _MADE.reset(token)
    needed = {part for df in kept for f in df.inputFiles() for part in f.split("/")}
    for name in made:
        if name.rsplit("/", 1)[1] not in needed:
            path, files = _path(spark, name)
            files.delete(path, True)
        elif outer is not None:
            outer.append(name)
    release(spark)


def narrow(df: DataFrame, carry: tuple[str, ...] = (), **columns: str) -> DataFrame:
    """The named columns under fixed names, whatever else df has, and those to carry
    along as fields of one struct, carried."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()], *carried)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, which must be saved, with a broadcast hint if it has at most `most` bytes; a value
    that isn't of fixed size is measured by its text."""
    fixed = sum(8 for _, t in df.dtypes if t in ("int", "bigint", "double", "boolean"))
    measured = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, t in df.dtypes if t not in ("int", "bigint", "double", "boolean")]
    size = df.agg(F.sum(sum(measured, F.lit(fixed + 8)))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph with edges (a, b): saved rows (id, component),
    component being the smallest id reachable.  Ids without an edge to another id
    have no row.

    Each round maps every node to its smallest neighbour, follows these pointers
    two doublings far, and contracts the edges, so a path of n nodes needs about
    log4 n rounds and a star one or two.  All state is in shared tables, two a round; a hot
    node only meets partial aggregates and joins against unique keys.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = save(edges.distinct(), "edges")
    rounds: list[DataFrame] = []
    renamed = lambda df, old, new: df.select(F.col("id").alias(old), F.col("up").alias(new))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("id", "other")
        up = save(both.groupBy("id").agg(F.least(F.min("other"), "id").alias("up")), "up")
        for _ in range(2):
            up = up.join(renamed(up, "up", "over"), "up").select("id", F.col("over").alias("up"))
        up = save(up, "up")
        rounds.append(up)
        edges = edges.join(renamed(up, "a", "x"), "a").join(renamed(up, "b", "y"), "b").where("x <> y")
        edges = save(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    whole = rounds[0]
    for up in rounds[1:]:  # only nodes that still had edges are in it
        whole = whole.join(renamed(up, "up", "over"), "up", "left").select("id", F.coalesce("over", "up").alias("up"))
    whole = whole.select("id", F.col("up").alias("component"))
    return save(whole, "components") if len(rounds) > 1 else whole
