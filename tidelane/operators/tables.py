"""Tables between steps, kept where driver and executors both reach them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def held(df: DataFrame) -> DataFrame:
    """df computed once and written to spark.checkpoint.dir, so that later steps do not compute it again.

    Where the setting is unset a temporary folder serves a session on one machine; a cluster gets an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="tidelane-")
        context.setCheckpointDir(at)
    return df.checkpoint()
