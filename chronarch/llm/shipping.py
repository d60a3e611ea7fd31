"""Arrays that every Python worker of a machine reads from one memory-mapped file.

The driver writes the file once and Spark brings it to each executor; workers map it
read-only, so its pages are shared and none of it is copied.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """The file's bytes: the length of the head, the head (name, type, number, offset of each array), the arrays."""
    head, at = [], 0
    for name, x in arrays.items():
        head.append((name, x.dtype.str, len(x), at))
        at += -(-x.nbytes // 8) * 8
    told = json.dumps(head).encode()
    told += b" " * (-len(told) % 8)
    return b"".join([len(told).to_bytes(8, "little"), told, *(x.tobytes() + bytes(-x.nbytes % 8) for x in arrays.values())])


class Mapped:
    """The arrays of a packed file, and the map itself, in which ``at`` tells where each begins."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self.map[:8], "little")
        self.arrays, self.at = {}, {}
        for name, kind, many, at in json.loads(self.map[8 : 8 + n]):
            self.at[name] = 8 + n + at
            self.arrays[name] = np.frombuffer(self.map, kind, many, self.at[name])

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]


def ship(spark: SparkSession, arrays: dict[str, np.ndarray], name: str) -> str:
    """Write the arrays to a file that Spark brings to all executors; returns the name by which ``shipped`` finds it."""
    name = f"{name}-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="chronarch-"), name)
    with open(path, "wb") as file:
        file.write(pack(arrays))
    spark.sparkContext.addFile(path)
    return name


@lru_cache(maxsize=4)
def shipped(name: str) -> Mapped:
    """Mapped once by each worker process."""
    return Mapped(SparkFiles.get(name))
