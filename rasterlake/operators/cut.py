"""Where lineage ends: tables that are used more than once are written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in spark.checkpoint.dir, computed once; lost executors cost nothing.

    Where that is unset, a local master gets a temporary folder, and a cluster a folder in its warehouse.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own:
            local = sc.master == "local" or sc.master.startswith("local[")
            own = tempfile.mkdtemp(prefix="rasterlake-") if local else df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(own)
    return df.checkpoint()
