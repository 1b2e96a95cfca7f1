"""Spark session defaults for tests and benchmarks.

Library code never builds its own session: every operator takes DataFrames. These helpers are for
entry points (tests, ``bench.py``) that need one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "trailmark") -> SparkSession:
    """Build (or reuse) a session with the settings the analyses are tuned for.

    * AQE on: coalesces the many small post-aggregate partitions, turns sort-merge joins into
      broadcast joins only after measuring the real (post-filter, post-aggregate) size, and splits
      skewed join partitions.
    * No UI server.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TRAILMARK_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only where none is configured.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is taken as is; a private
    temporary folder is only created for runs inside one process (tests) where the setting is
    absent. Anywhere else its absence is an error: other machines would not see the files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder (master is {master})")
        configured = tempfile.mkdtemp(prefix="trailmark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scale_settings(input_bytes: int, total_cores: int,
                   target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Suggested settings for a cluster run over ``input_bytes`` of parquet on ``total_cores``.

    * initial shuffle partitions: enough that a partition of the largest shuffle (at most the
      input size, usually far less after partial aggregation) is ~``target_partition_bytes``,
      rounded up to a multiple of the cores; adaptive execution coalesces small ones at run time;
    * scan splits of 256 MB; advisory post-shuffle size 128 MB;
    * skew: a partition 5x the median and over 256 MB is split (joins), the default rule.
    """
    parts = max(total_cores, -(-input_bytes // target_partition_bytes))
    parts = -(-parts // total_cores) * total_cores
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    }
