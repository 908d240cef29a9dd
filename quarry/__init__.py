"""quarry: a PySpark-native engine for building, checking and querying a corpus of sourced claims."""

from __future__ import annotations

import os
import tempfile
import zipfile


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark) -> None:
    """Makes this package importable in the Python workers of the session's executors, once per session, and bounds Arrow batches where the session doesn't."""
    if spark.conf.get(ARROW_ROWS) == "10000":  # the default, for which a batch of long texts takes hundreds of MB on each side
        spark.conf.set(ARROW_ROWS, "1024")
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._quarry_shipped = True
