"""Directory trees as a corpus.

`binaryFile` leaves out names that start with `_` or `.`, such as `__init__.py`, so trees are listed by
Spark jobs that open folders, round by round. Contents are read in a second step that is spread
evenly over all files, whatever folder they lie in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.paths import contained
from codeaudit.functions.text import decode
from codeaudit.storage import materialize

# Folders that a task opens in one round; what it meets beyond them is dealt out anew.
ROUND_FOLDERS = 256
BATCH_FILES = 1_000
BATCH_BYTES = 32 << 20
_LISTED = "path string, size bigint, is_folder boolean"


def _entries(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))


def _listing(rows: list[tuple[str, int | None, bool]]) -> pa.RecordBatch:
    kinds = (("path", pa.string()), ("size", pa.int64()), ("is_folder", pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


def _wide(spark: SparkSession) -> int:
    """Tasks of a step that is heavy although its input is small in bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def list_tree(spark: SparkSession, root: str, round_folders: int = ROUND_FOLDERS) -> DataFrame:
    """`(path, size)` of the regular files below `root`, a path or URI that all executors see.

    A file is listed under its own name; a missing root has no rows. In each round the known folders are
    dealt out by hash; a task opens its folders and those below them, up to its number, and hands the
    rest to the next round. So a deep chain takes few rounds and one wide folder's children spread.
    """

    def open_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        waiting = [path for batch in batches for path in batch.column(0).to_pylist()]
        rows, opened = [], 0
        while waiting and opened < round_folders:
            folder = waiting.pop()
            opened += 1
            if not folder and (own := fs.get_file_info(base)).type == pafs.FileType.File:
                rows.append((base.rsplit("/", 1)[-1], own.size, False))
                continue
            for entry in _entries(fs, f"{base}/{folder}" if folder else base):
                path = entry.path[len(base):].lstrip("/")
                if entry.type == pafs.FileType.File:
                    rows.append((path, entry.size, False))
                elif entry.type == pafs.FileType.Directory:
                    waiting.append(path)
                if len(rows) >= BATCH_FILES:
                    yield _listing(rows)
                    rows = []
        yield _listing([*rows, *((path, None, True) for path in waiting)])

    folders, rounds = spark.createDataFrame([("",)], "path string"), []
    while True:
        listed = materialize(folders.repartition(_wide(spark), "path").mapInArrow(open_folders, _LISTED), "tree")
        rounds.append(listed.filter("NOT is_folder").select("path", "size"))
        folders = listed.filter("is_folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionAll, rounds)


def scan_tree(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """Files of a tree as `(repo, path, content)`.

    Without `repo`, the first component of each path names its repository.
    """
    spread = list_tree(spark, root).select("path").repartition(_wide(spark), "path")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        single = fs.get_file_info(base).type == pafs.FileType.File
        for batch in batches:
            paths, raws, held = [], [], 0
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(base if single else f"{base}/{path}") as stream:
                    raw = stream.read()
                paths.append(path)
                raws.append(raw)
                held += len(raw)
                if held >= BATCH_BYTES:
                    yield _contents(paths, raws)
                    paths, raws, held = [], [], 0
            if paths:
                yield _contents(paths, raws)

    read = spread.mapInArrow(load, "path string, raw binary")
    if repo is not None:
        return read.select(F.lit(repo).alias("repo"), "path", decode(F.col("raw")).alias("content"))
    return read.select(
        F.substring_index("path", "/", 1).alias("repo"),
        F.expr("substring(path, instr(path, '/') + 1)").alias("path"),
        decode(F.col("raw")).alias("content"),
    )


def _contents(paths: list[str], raws: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(raws, pa.binary())], names=["path", "raw"]
    )


def write_tree(files: DataFrame, root: str) -> int:
    """Write `(repo, path, content)` below `root` as `repo/path`, and return the number of files.

    Paths that would leave their repository are not written. A repeated task writes the same
    files again.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{base}/{row['repo']}/{row['path']}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(target) as stream:
                    stream.write(row["content"].encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    inside = contained(F.col("path")).alias("path")
    safe = files.select("repo", inside, "content").filter(
        F.col("path").isNotNull() & (contained(F.col("repo")) == F.col("repo"))
    )
    return safe.mapInArrow(store, "n bigint").agg(F.sum("n")).first()[0] or 0
