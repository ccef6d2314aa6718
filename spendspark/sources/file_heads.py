"""The first bytes of files that Spark has listed, read in the tasks that hold their rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# schemes that pyarrow opens, with the scheme it knows them by
SCHEMES = {"": "file", "file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs"}


# Spark gives paths as they are, without escapes
PATH = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(.*)", re.DOTALL)


def opens(path: str) -> bool:
    return (PATH.match(path)[1] or "") in SCHEMES


def first_bytes(path: str, n: int, known: dict[tuple[str, str], fs.FileSystem]) -> bytes:
    """Reads n bytes of one file and no more. known keeps a file system per scheme and host."""
    scheme, host, name = PATH.match(path).groups(default="")
    scheme = SCHEMES[scheme]
    if scheme in ("s3", "gs"):
        name = f"{host}{name}"
    system = known.get((scheme, host))
    if system is None:
        system = fs.LocalFileSystem() if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}://{host}/")[0]
        known[scheme, host] = system
    with system.open_input_file(name) as file:
        return file.read_at(n, 0)


def with_heads(files: DataFrame, n: int, path: str = "path", head: str = "head") -> DataFrame:
    """files with the first n bytes of each in a binary column; a file shorter than that gives what it has."""
    kept = [f for f in files.schema.fields if f.name != head]
    schema = T.StructType([*kept, T.StructField(head, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], fs.FileSystem] = {}
        for batch in batches:
            heads = pa.array([first_bytes(p, n, known) for p in batch.column(path).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), heads], names=schema.names)

    return files.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
