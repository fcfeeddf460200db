"""Session settings and the shared working folder."""

from __future__ import annotations

import io
import os
import site
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = "brimwatch"
_SESSION_CONF = {
    # All timestamps are UTC instants.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: partition coalescing, size-checked broadcast, skew split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot keys also where the split costs one more shuffle of the result.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows go to Python by bytes and not by number: texts may be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every operator here assumes."""
    for key, value in _SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, unless they find it by themselves.

    They do where it is installed, or its folder is in PYTHONPATH, or is the
    working folder of a single-machine session. Else a zip of it goes to the
    shared folder and from there to every worker.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages(), site.getusersitepackages()]
    if context.master.startswith("local["):
        found.append(os.getcwd())
    if any(p and os.path.realpath(p) == os.path.realpath(root) for p in found):
        return
    if any(name.startswith(f"{_PACKAGE}-") for name in context._python_includes):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(os.path.join(root, _PACKAGE))):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    target = f"{shared_dir(spark)}/{_PACKAGE}-{uuid.uuid4().hex}.zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(target)


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brimwatch")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-machine
    session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    current = context.getCheckpointDir()
    if current is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="brimwatch-"))
        current = context.getCheckpointDir()
    return current.removeprefix("file:").rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet used path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives executor loss."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
