"""Class folders in a file system that tasks open by themselves: one small file per document.

Spark's writer creates files there through Hadoop, which without its native library starts
a process for each permission it sets, and Spark's reader lists all files on the driver.
Here tasks create, list and read the files; the driver sees the folders of the root.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeforge.session import ship_package

# Spark's folder for a value that is null or empty, and what it escapes in others.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
# A batch of contents holds about so many bytes, or one longer file.
BATCH_BYTES = 4_000_000
FILES = "path string, content binary"


def local_root(spark: SparkSession, root: str) -> str | None:
    """The plain path of a root in the file system of the machines; else, or for a pattern, None."""
    scheme, rest = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", root, re.S).groups()
    if scheme is None:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:"
        scheme = default.partition(":")[0]
    rest = re.sub("^//(?=/)", "", rest)
    if scheme != "file" or rest.startswith("//") or re.search(r"[*?{}\[\]\\]", rest):
        return None
    return os.path.abspath(rest)


def folder_name(column: str, value: str | None) -> str:
    """``column=value`` as Spark's writers name it."""
    def escape(text: str) -> str:
        return ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", text)

    return f"{escape(column)}={escape(value) if value else NO_VALUE}"


def hidden(name: str) -> bool:
    """Whether Spark's readers leave out files or folders of this name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name[0] == "_" and "=" not in name)


def write_files(df: DataFrame, root: str, label: str, text: str) -> int:
    """Write one file per row below ``root``, in a folder per label; returns their number.

    A file appears under its name when it is complete. The name follows from the number of
    the partition and the row's place among those of its label, so a task that runs again
    replaces what it wrote before.
    """
    ship_package(df.sparkSession)
    os.makedirs(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, placed = TaskContext.get(), Counter()
        for batch in batches:
            for value, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                folder = f"{root}/{folder_name(label, value)}"
                if not placed[folder]:
                    os.makedirs(folder, exist_ok=True)
                name = f"part-{task.partitionId():05d}-{placed[folder]:09d}.txt"
                placed[folder] += 1
                begun = f"{folder}/.{name}.{task.taskAttemptId()}"
                with open(begun, "wb", buffering=0) as out:
                    left = memoryview(content.as_buffer())
                    while left:
                        left = left[out.write(left):]
                os.replace(begun, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"n": [placed.total()]}, pa.schema([("n", pa.int64())]))

    rows = df.select(F.col(label).cast("string"), text)
    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _below(folder: str, deep: bool) -> Iterator[str]:
    """Paths of the files of a folder and, if ``deep``, of the folders in it."""
    inner = []
    with os.scandir(folder) as found:
        for entry in found:
            if hidden(entry.name):
                continue
            if entry.is_dir():
                inner.append(entry.path)
            else:
                yield entry.path
    for path in inner if deep else ():
        yield from _below(path, deep)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string())])
    for batch in batches:
        for folder, deep in zip(*(column.to_pylist() for column in batch.columns)):
            paths = []
            for path in _below(folder, deep):
                paths.append(path)
                if len(paths) == 10_000:
                    yield pa.RecordBatch.from_pydict({"path": paths}, schema)
                    paths = []
            yield pa.RecordBatch.from_pydict({"path": paths}, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    for batch in batches:
        paths, contents, held = [], [], 0
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as file:
                contents.append(file.read())
            paths.append(f"file:{path}")
            held += len(contents[-1])
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=schema)
                paths, contents, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=schema)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below ``root``, empty ones included.

    A folder of the root is listed by one task; the files found are dealt to all tasks by path.
    """
    ship_package(spark)
    with os.scandir(root) as found:
        folders = [entry.path for entry in found if entry.is_dir() and not hidden(entry.name)]
    rows = [(root, False), *((path, True) for path in folders)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    walked = spark.createDataFrame(rows, "folder string, deep boolean").repartition(min(len(rows), parts), "folder")
    paths = walked.mapInArrow(_list, "path string").repartition(parts, "path")
    return paths.mapInArrow(_read, FILES)
