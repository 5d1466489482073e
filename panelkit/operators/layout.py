"""Rows in files in the order of their positions, so that a task can read any run of positions without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.schema import DATE, KEYS, TARGET
from panelkit.session import new_folder

#: Rows of a file.
FILE_ROWS = 1_000_000


class Layout:
    """Files of doubles for each split (0 or 1): the target by itself, the other columns row by row.

    The shared folder must be one that Arrow's file systems reach (local or mounted paths, HDFS, S3).
    """

    def __init__(self, folder: str, width: int, pieces: Mapping[int, Sequence[tuple[str, int]]], stretch_rows: int) -> None:
        self.folder, self.width, self.stretch_rows = folder, width, stretch_rows
        self.names = {which: [name for name, _ in of] for which, of in pieces.items()}
        self.starts = {which: np.r_[0, np.cumsum([n for _, n in of])].astype(np.int64) for which, of in pieces.items()}
        self.sizes = {which: int(starts[-1]) for which, starts in self.starts.items()}

    def stretches(self, spark: SparkSession) -> DataFrame:
        """``__s, stretch`` of all stretches."""

        parts = [(which, -(-n // self.stretch_rows)) for which, n in self.sizes.items()]
        first = parts[0][1]
        return spark.range(sum(n for _, n in parts)).select((F.col("id") >= first).cast("int").alias("__s"), F.when(F.col("id") < first, F.col("id")).otherwise(F.col("id") - first).alias("stretch"))

    def stretch(self, which: int, stretch: int) -> tuple[int, int]:
        return stretch * self.stretch_rows, min((stretch + 1) * self.stretch_rows, self.sizes[which])

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
        """Split, first position and end of each stretch in the batches of ``stretches``."""

        for batch in batches:
            for which, stretch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield (which, *self.stretch(which, stretch))

    def rows(self, which: int, start: int, end: int) -> np.ndarray:
        """The columns beside the target, one row a position."""

        with Runs(self, which, "rows", self.width) as runs:
            return runs.take(start, end).reshape(-1, self.width)

    def targets(self, which: int) -> Runs:
        return Runs(self, which, "target", 1)

    def target_rows(self, spark: SparkSession, split: str) -> DataFrame:
        """Split, position ``i`` and target of all rows."""

        names = [split, "i", TARGET]

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for which, start, end in self.read(batches):
                with self.targets(which) as targets:
                    y = targets.take(start, end)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), which, np.int32)), pa.array(np.arange(start, end)), pa.array(y)], names=names)

        return self.stretches(spark).mapInArrow(emit, f"{split} int, i long, {TARGET} double").withColumn(DATE, F.lit(0))


class Runs:
    """Reads runs of positions of one split; files are opened once."""

    def __init__(self, laid: Layout, which: int, kind: str, width: int) -> None:
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(laid.folder)
        self.names, self.starts, self.kind, self.bytes = laid.names[which], laid.starts[which], kind, 8 * width
        self.open: dict[int, pa.NativeFile] = {}

    def __enter__(self) -> Runs:
        return self

    def __exit__(self, *_) -> None:
        for f in self.open.values():
            f.close()

    def take(self, start: int, end: int) -> np.ndarray:
        parts, k = [], int(np.searchsorted(self.starts, start, side="right")) - 1
        while start < end:
            if k not in self.open:
                self.open[k] = self.fs.open_input_file(f"{self.path}/{self.names[k]}.{self.kind}")
            stop = min(end, int(self.starts[k + 1]))
            parts.append(np.frombuffer(self.open[k].read_at((stop - start) * self.bytes, (start - int(self.starts[k])) * self.bytes)))
            start, k = stop, k + 1
        return np.concatenate(parts) if parts else np.zeros(0)

    def gather(self, runs: np.ndarray, start: int, end: int) -> np.ndarray:
        """Values of the places start to end, where runs are (first place, first position, rows) by place."""

        first = max(0, int(np.searchsorted(runs[:, 0], start, side="right")) - 1)
        parts = []
        for place, position, n in runs[first : int(np.searchsorted(runs[:, 0], end))].tolist():
            low, high = max(place, start), min(place + n, end)
            if low < high:
                parts.append(self.take(position + low - place, position + high - place))
        return np.concatenate(parts) if parts else np.zeros(0)


def lay_out(df: DataFrame, columns: Sequence[str], target: str, *, split: str, stretch_rows: int) -> Layout:
    """Write the rows in the order of split and key; a task reads a stretch of ``stretch_rows`` at once. Names of files are new in each attempt of a task; the lines that Spark
    returns name those that count."""

    spark, width = df.sparkSession, len(columns)
    folder = new_folder(spark, "layout")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // FILE_ROWS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        held: dict[int, list] = {}
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for which in np.unique(values[0]).tolist():
                mine = values[0] == which
                if which not in held:
                    name = uuid.uuid4().hex
                    held[which] = [name, [int(v[mine][0]) for v in values[1:4]], 0, fs.open_output_stream(f"{path}/{name}.target"), fs.open_output_stream(f"{path}/{name}.rows")]
                one = held[which]
                one[2] += int(mine.sum())
                one[3].write(np.ascontiguousarray(values[4][mine], np.float64).tobytes())
                one[4].write(np.column_stack([v[mine] for v in values[5:]]).astype(np.float64).tobytes())
        for which, (name, key, n, *files) in held.items():
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"s": pa.array([which], pa.int32()), "k": pa.array([key], pa.list_(pa.int64())), "n": pa.array([n], pa.int64()), "name": [name]})

    narrow = df.select(F.col(split).cast("int").alias(split), *[F.col(k).cast("long").alias(k) for k in KEYS], target, *columns)
    order = [split, *KEYS]
    lines = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(write, "s int, k array<long>, n long, name string").collect()
    pieces: dict[int, list] = {0: [], 1: []}
    for r in sorted(lines, key=lambda r: (r["s"], list(r["k"]))):
        pieces[r["s"]].append((r["name"], r["n"]))
    return Layout(folder, width, pieces, stretch_rows)
