"""Session set-up shared by jobs, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def spark_session(master: str | None = None, app: str = "tidewatch", **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    Parallelism, memory and the checkpoint folder belong to the cluster; they
    are only set when the caller passes them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # no stack trace per column expression: conditions are made of many
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # the form of instants whose file statistics filters can use
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The reliable checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. A fallback is taken only
    where that is unset, as in local tests.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        import tempfile

        folder = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
    context.setCheckpointDir(folder)
    return folder
