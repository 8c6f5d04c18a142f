"""Checksums of files, read as streams inside tasks."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle

# sent to the workers by value, so that they need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 8 << 20


def open_stream(path: str):
    """A file of any file system pyarrow knows by its scheme; without a scheme, or with ``file:``, a local path."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem().open_input_stream(path, compression=None)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=None)
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_stream(place, compression=None)


def md5_of(path: str) -> str:
    digest = hashlib.md5()
    with open_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def md5_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes) -> (path, md5, bytes); no more than one chunk of one file is held."""
    for batch in batches:
        sums = pa.array([md5_of(path.as_py()) for path in batch.column(0)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), sums, batch.column(1)], names=["path", "md5", "bytes"])
