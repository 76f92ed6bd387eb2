"""Byte files in the shared folder, for the sinks and readers that work on raw bytes inside tasks.

Paths are URIs; pyarrow's file systems open them (file, s3, gs, hdfs). A task writes under a name of
its own attempt and moves the file into place when complete, so a task that is run
again after an executor is lost replaces its file by an equal one.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark import TaskContext


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


@contextlib.contextmanager
def replacing(uri: str) -> Iterator[BinaryIO]:
    """Open a file for writing that appears at uri only once it is whole."""
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 0}.part"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)


@contextlib.contextmanager
def reading(uri: str) -> Iterator[BinaryIO]:
    """Open a file for random access."""
    system, path = locate(uri)
    with system.open_input_file(path) as source:
        yield source
