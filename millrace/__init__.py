"""Analytics over feeds of short text records on PySpark DataFrames, SQL and Structured Streaming."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors, so that Python workers can import it.

    Needed once a session; where the package is installed on every machine it does no harm.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # on the driver, which serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{here.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, str(f.relative_to(here.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
