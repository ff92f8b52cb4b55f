"""Session construction and the shared scratch folder.

Iterative operators cut their lineage by writing a table into the folder that
``spark.checkpoint.dir`` names. On a cluster that folder is shared by all
executors, so a lost executor loses nothing. Only a local session without the setting
(tests, notebooks) gets a temporary folder; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "vidloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=base | conf).getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vidloom-ship-")) / "vidloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(home):
            for n in names:
                if n.endswith(".py"):
                    z.write(Path(root) / n, Path("vidloom") / Path(root).relative_to(home) / n)
    sc.addPyFile(str(target))


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, read from the session first."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        named = spark.sparkContext.getCheckpointDir() or ""
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vidloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, below ``spark.checkpoint.dir``.

    ``table`` writes a frame as Parquet and reads it back, which cuts the lineage
    and makes every later use see the very same rows. ``drop`` frees a table that
    no later step reads. What is left is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/vidloom-{label}-{uuid.uuid4().hex[:12]}"
        _written.append((spark, self.root))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path, seen = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._vidloom_path = path
        back._vidloom_rows = seen.get["rows"]
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_vidloom_path", None)
            if path:
                _remove(self.spark, path)


def rows_of(table: DataFrame) -> int:
    """Number of rows; a scratch table knows it from its writing."""
    known = getattr(table, "_vidloom_rows", None)
    return table.count() if known is None else known


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, root in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, root)
        except Exception:
            pass
