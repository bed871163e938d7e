"""Session helpers: a local session for tests, and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Sources without statistics report the largest long, unless the session sets another default.
UNKNOWN_BYTES = 1 << 60


def local_session(cores: str = "*", app: str = "shelfscope", **settings: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is read from ``spark.checkpoint.dir``, or from a checkpoint folder the application set itself. Only a
    local session that has neither gets a fresh temporary folder: there, all tasks share one machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_folder(spark).rstrip('/')}/shelfscope-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def input_bytes(df: DataFrame) -> int | None:
    """Size of ``df`` from the optimizer's own statistics; None where they are out of reach.

    The larger of two figures: all that the plan reads, which column pruning does not shrink, and the estimate for its
    output, which multiplies the sides of a join.
    """
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    optimized = plan.queryExecution().optimizedPlan()
    return max(sum(_leaf_bytes(optimized)), int(optimized.stats().sizeInBytes()))


def _leaf_bytes(optimized) -> list[int]:
    leaves = optimized.collectLeaves()
    return [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]


def read_bytes(df: DataFrame) -> int | None:
    """Size of all that ``df`` reads, by the optimizer's statistics; None where a source does not know its own."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    sizes = _leaf_bytes(plan.queryExecution().optimizedPlan())
    return None if any(size >= UNKNOWN_BYTES for size in sizes) else sum(sizes)


def prepare(spark: SparkSession) -> None:
    """What the library expects of a session, set once per application.

    Skewed join partitions are split also where a later step needs the join key together, at the price of one more
    shuffle for the skewed case. The package is sent to the executors for the tasks that use numpy.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application: tasks that use numpy import it there."""
    context = spark.sparkContext
    if getattr(context, "_shelfscope_shipped", False):
        return
    source = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="run-")) / "shelfscope.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(source.rglob("*.py")):
            archive.write(file, file.relative_to(source.parent))
    context.addPyFile(str(target))
    context._shelfscope_shipped = True
