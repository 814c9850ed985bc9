"""A PySpark engine for knowledge bases of documents, telemetry of builds and assistants, and training corpora."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the Python workers of a session, once; they need not have it installed.

    Every registered query does so. Who calls operators directly, from a driver that was not started beside the
    package, calls it first.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    # the driver's file server hands the archive to the executors
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "sagebrush.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.join("sagebrush", os.path.relpath(file, home)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
