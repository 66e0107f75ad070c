"""Session helpers.

Library code never creates a session; it takes the caller's. ``local_session``
is for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan here benefits from: AQE re-plans joins from runtime
# sizes (small sides become broadcasts without a static guess) and splits
# skewed partitions of hot keys.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "scriptorium", input_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if input_partitions:
        spark.conf.set("scriptorium.input.partitions", str(input_partitions))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets
    a scratch folder; a cluster session is an error, because executors would
    each write to their own disk."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="scriptorium-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder (never a machine-local
    temp dir on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), name)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint folder, removed when the
    application ends."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stage(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    return a DataFrame reading it back: an intermediate used by several
    branches of a plan is then computed once, its lineage is cut, and it
    survives the loss of an executor (unlike a cache). The folder is removed
    when the application ends."""
    path = scratch_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """Deal ``df`` round-robin into ``scriptorium.input.partitions`` partitions
    where the caller has set that option (local runs on files of a single row
    group, which would scan as one task); otherwise ``df`` as it is. The plan
    never depends on the size of the input."""
    n = df.sparkSession.conf.get("scriptorium.input.partitions", None)
    return df.repartition(int(n)) if n else df
