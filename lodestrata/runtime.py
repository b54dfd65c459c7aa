"""What a session needs to run the package's Python functions on executors."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch on its way to Python: several copies of it live at once in a worker and beside it.
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once per application; they need no installed copy of it. Arrow batches of the session are bounded to BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).parent
        handle, path = tempfile.mkstemp(prefix="lodestrata-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def lean(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f, which maps Arrow batches, with its worker's unused memory given back when the task ends: workers outlive their tasks, and several wait beside one that works."""

    @functools.wraps(f)
    def mapped(batches: Iterator[pa.RecordBatch], *more) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches, *more)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some systems have it
            if trim:
                trim(0)

    return mapped
