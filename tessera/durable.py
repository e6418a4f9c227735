"""Durable cuts of lineage in the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count
from threading import Event, Thread

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a temporary one on a single machine (tests); on a
    cluster, whose machines don't share such a folder, that is an error."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: After so many cuts the driver collects its garbage, which lets Spark delete shuffle and checkpoint files that nothing
#: refers to any more (checkpoints with spark.cleaner.referenceTracking.cleanCheckpoints=true). Iterative operators
#: would else hold all their files until the driver's heap is full.
RELEASE_EVERY = 1
#: And after so many seconds while one cut is written: thousands of tasks leave the driver's heap full of garbage, which it would
#: grow for up to its limit.
RELEASE_SECONDS = 10
_cuts = count(1)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from the files: a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    with releasing(df.sparkSession):
        out = df.checkpoint(eager=True)
    if next(_cuts) % RELEASE_EVERY == 0:
        release(df.sparkSession)
    return out


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Release every RELEASE_SECONDS while what is inside runs."""
    done = Event()

    def run() -> None:
        while not done.wait(RELEASE_SECONDS):
            release(spark)

    beside = Thread(target=run, daemon=True)
    beside.start()
    try:
        yield
    finally:
        done.set()
        beside.join()


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, which lets Spark delete files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
