"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back. The session's ``spark.checkpoint.dir`` names the folder;
    only where it is unset (tests) is a temporary one used."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lattiq-checkpoint"))
    return df.checkpoint(eager=True)
