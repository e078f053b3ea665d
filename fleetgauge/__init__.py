"""fleetgauge: lazy PySpark operators for running machine-learning platforms.

Sub-packages
------------
functions   column and frame helpers shared by the operators
sources     readers and writers
operators   the DataFrame-to-DataFrame operators, one module per area
streaming   Structured Streaming forms of the time-based operators
plans       domain views, user pipelines and the registered queries
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers of the session, once per application.

    Operators that run Python in tasks need it there; a cluster that has the
    package installed on every node does not need the call.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fleetgauge-")) / "fleetgauge.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
