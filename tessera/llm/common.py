"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of an Arrow batch in sessions of the registered queries; a batch is held whole.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20
#: Rows up to which a checkpointed helper table may be broadcast (about 24 bytes a row).
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset, a session with a local master gets a temporary one, as in tests; any other raises, since
    executors of a cluster can't see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder with its lineage cut; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (cheap to count) marked for broadcast if it has at most ``most`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes in this session.

    For programs that own their session, as the registered queries do; operators leave the session's settings alone.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _bytes(spark.conf.get(f"spark.sql.execution.arrow.{key}")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def _bytes(setting: str) -> int:
    found = re.fullmatch(r"(-?\d+)([kmg]?)b?", setting.lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else 0


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()  # a worker lives on for other tasks


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
