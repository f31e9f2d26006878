"""Session settings, table access and scratch tables shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side that was written and counted may be broadcast.
BROADCAST_ROWS = 200_000
#: And up to which bytes, by its files.
BROADCAST_BYTES = 32 << 20


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A session for tests, benchmarks and single machines; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("quillmesh")
    settings = {
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` where it is set.

    Only a session on one machine without that setting (tests) gets a folder of its own, removed at exit; on a cluster
    no machine's own folder would do.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    own = os.environ.get("QUILLMESH_SCRATCH")
    if not own:
        own = os.environ["QUILLMESH_SCRATCH"] = tempfile.mkdtemp(prefix="quillmesh-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


_made: list[str] = []


def _clean() -> None:
    """Removes the scratch tables of an ended driver where their folder is a mounted one; other stores have their own expiry."""
    for path in _made:
        local = path.removeprefix("file://")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)


atexit.register(_clean)


class Scratch:
    """Written tables that cut lineage and survive the loss of executors.

    ``write`` stores a frame and reads it back, so later plans know its size; ``drop`` removes tables
    that an iteration no longer needs.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _made.append(self.path)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n:04d}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        at = getattr(df, "_scratch_path", None)
        if at:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if its rows, counted, and its bytes, as its files tell, are within the bounds.

    Otherwise the frame is left as it is, for a shuffle join.
    """
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if known <= size and df.limit(rows + 1).count() <= rows else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers of a session this package, once, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillmesh-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/quillmesh.zip", "w") as z:
        for at, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.join("quillmesh", os.path.relpath(os.path.join(at, f), root)))
    sc.addPyFile(f"{folder}/quillmesh.zip")
    _shipped.add(sc.applicationId)
