"""lattica: a DataFrame-first engine for knowledge-graph retrieval over document collections."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

_SHIPPED: set[str] = set()
#: Bytes of a record batch that goes to a Python worker, where the session sets none: rows hold whole texts.
BATCH_BYTES = "4m"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark) -> None:
    """Send this package's modules to the Python workers of ``spark``, once for each application, and bound
    the bytes of a record batch where the session does not.

    Worker-side functions are pickled by reference, so workers must be able to import the package even
    where it isn't installed on the executors.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()  # the driver's own; it serves the file to executors while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "lattica_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for here, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    z.write(full, os.path.join("lattica", os.path.relpath(full, top)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
