"""Session helpers: shared scratch space and lineage cuts.

Nothing here starts a session of its own except :func:`local_session`, which
tests and the bench use.  On a cluster the caller's session is used as it is.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "claimloom", **conf: str) -> SparkSession:
    """A local-mode session with the settings the tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` wins.  Only a local-mode session without that
    setting gets a folder of its own; a cluster session without it is an error,
    because a machine-local folder would not be visible to other executors.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if current.isEmpty():
            context.setCheckpointDir(configured)
        return configured
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="claimloom-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared root; nothing is deleted or reused."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder, survives lost executors), sized by the files it was written to.

    Spark's own size of a join is the product of its sides' sizes, and a checkpoint hands it on: in a loop of joins its
    digits multiply each round, until the driver's memory and time go into them.  After an explode it is too low
    instead, and a table that is too large for it is broadcast.
    """
    shared_root(df.sparkSession)
    return _sized(df.checkpoint(eager=True))


def _sized(kept: DataFrame) -> DataFrame:
    """A checkpoint's rows, partitions and order; as its size the planner sees eight times the length of its files."""
    spark, plan = kept.sparkSession, kept._jdf.logicalPlan()
    # The plan of a scan has the length of the files as its size; nothing is read.  They are compressed, the rows of a broadcast are not.
    scan = spark.read.text(plan.rdd().getCheckpointFile().get())
    for _ in range(3):
        scan = scan.unionAll(scan)
    stats, some, none = scan._jdf.logicalPlan().stats(), spark._jvm.scala.Option.apply, spark._jvm.scala.Option.empty()
    # Of no rows the size is left open: a join with them would seem empty, whatever its other side.
    sized = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
                      spark._jsparkSession, some(stats) if stats.sizeInBytes() else none, some(plan.constraints()))
    return type(kept)(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sized), spark)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with at least as many partitions as there are cores.

    For row work that is heavy on CPU.  A large table already has more input
    splits than that and is returned as it is; only a scan of a few small files
    gets one cheap exchange.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
