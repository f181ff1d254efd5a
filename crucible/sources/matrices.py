"""Matrices as a source of Spark's: .npy files read by ranges of rows and written as numbered parts, neither whole in one task or on the driver."""

from __future__ import annotations

import io
import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from crucible.functions.shipping import ship
from crucible.functions.tables import settled, with_running

SCHEMA = "row_index long, vector array<float>"
#: The list of parts, written last.
HEADER = "matrix.json"
#: Bytes before the numbers of a single file.
LEAD = 128
#: Bytes of rows that a task holds, in reading and in writing.
BLOCK = 32 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which may have a scheme, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _header(f) -> tuple[int, int, np.dtype, bool, int]:
    """Rows, components, type, whether columns lie together, and where the data begin."""
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject or kind.kind not in "fiu" or len(shape) != 2:
        raise ValueError(f"a matrix of numbers is wanted, not {kind} of shape {shape}")
    return shape[0], shape[1], kind, fortran, f.tell()


@dataclass
class Rows(InputPartition):
    """Rows first to first + count - 1 of a file, numbered from index."""

    path: str
    first: int
    count: int
    index: int


@dataclass
class Parts(WriterCommitMessage):
    """(file, number of its first row, rows, components) of each part that a task wrote."""

    parts: list[tuple[str, int, int, int]]


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def files(self, store: fs.FileSystem, at: str) -> list[tuple[str, int]]:
        """Each file and the number of its first row: from the list of parts where there is one, else 0."""
        if store.get_file_info(at).type != fs.FileType.Directory:
            return [(at, 0)]
        if store.get_file_info(f"{at}/{HEADER}").type == fs.FileType.File:
            with store.open_input_stream(f"{at}/{HEADER}") as f:
                return [(f"{at}/{p['file']}", p["first_row"]) for p in json.loads(f.read())["parts"]]
        return sorted((x.path, 0) for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".npy"))

    def partitions(self) -> list[Rows]:
        store, at = _store(self.path)
        out = []
        for path, index in self.files(store, at):
            with store.open_input_file(path) as f:
                n, width, kind, fortran, _ = _header(f)
            step = max(n, 1) if fortran else max(1, self.block // max(1, width * kind.itemsize))
            out += [Rows(path, i, min(step, n - i), index + i) for i in range(0, n, step)]
        return out

    def read(self, partition: Rows | None):
        if partition is None:  # what Spark asks for where there are no rows
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as f:
            n, width, kind, fortran, start = _header(f)
            if fortran:  # columns lie together: a range of rows is spread over the file
                rows = np.frombuffer(f.read(n * width * kind.itemsize), kind).reshape(width, n).T
            else:
                f.seek(start + partition.first * width * kind.itemsize)
                rows = np.frombuffer(f.read(partition.count * width * kind.itemsize), kind).reshape(partition.count, width)
        for k in range(0, partition.count, 4096):
            part = np.ascontiguousarray(rows[k : k + 4096], np.float32)
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
            vectors = pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part), dtype=np.int64) + partition.index + k), vectors], names=["row_index", "vector"])


class MatrixWriter(DataSourceArrowWriter):
    """Tasks write parts under names of their own; only parts that the list names count, so what lost or repeated tasks wrote does not."""

    def __init__(self, path: str, block: int, overwrite: bool):
        self.path, self.block, self.overwrite = path, block, overwrite

    def write(self, iterator) -> Parts:
        store, at = _store(self.path)
        store.create_dir(at)
        done: list[tuple[str, int, int, int]] = []
        held: list[np.ndarray] = []
        first = count = 0

        def put():
            nonlocal held, count
            if count:
                m = np.concatenate(held)
                done.append((self.place(store, at, first, m), first, *m.shape))
            held, count = [], 0

        for batch in iterator:
            index, vectors = batch.column("row_index").to_numpy(zero_copy_only=False), batch.column("vector")
            if vectors.flatten().null_count:
                raise ValueError("a component is null")
            values, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
            if not len(sizes):
                continue
            if vectors.null_count:
                raise ValueError("a vector is null")
            if (sizes != sizes[0]).any() or (held and held[0].shape[1] != sizes[0]):
                raise ValueError("vectors have different lengths")
            rows = values.astype(np.float32).reshape(len(index), int(sizes[0]))
            step = max(1, self.block // max(1, 4 * rows.shape[1]))
            for run in np.split(np.arange(len(index)), np.flatnonzero(np.diff(index) != 1) + 1):
                while len(run):
                    if count and (index[run[0]] != first + count or count >= step):
                        put()
                    if not count:
                        first = int(index[run[0]])
                    take, run = run[: step - count], run[step - count :]
                    held.append(rows[take])
                    count += len(take)
        put()
        return Parts(done)

    def place(self, store: fs.FileSystem, at: str, first: int, m: np.ndarray) -> str:
        name = f"part-{uuid.uuid4().hex}.npy"
        with store.open_output_stream(f"{at}/{name}") as f:
            np.lib.format.write_array(f, m, (1, 0), allow_pickle=False)
        return name

    def ordered(self, messages) -> tuple[list[tuple[str, int, int, int]], int]:
        """All parts in the order of their rows, and how many rows; an error where rows are missing or twice, or lengths differ."""
        parts = sorted((x for m in messages if m for x in m.parts), key=lambda x: x[1])
        n = 0
        for _, first, count, width in parts:
            if first != n or width != parts[0][3]:
                raise ValueError(f"rows from {n} on are missing, twice or of another length")
            n += count
        return parts, n

    def commit(self, messages) -> None:
        """The list of parts."""
        store, at = _store(self.path)
        parts, n = self.ordered(messages)
        store.create_dir(at)
        header, before = f"{at}/{HEADER}", []
        if store.get_file_info(header).type == fs.FileType.File:
            if not self.overwrite:
                raise ValueError(f"{self.path} holds a matrix already")
            before = [p for p, _ in MatrixReader(self.path, self.block).files(store, at)]
        listed = [{"file": name, "first_row": first, "rows": count} for name, first, count, _ in parts]
        with store.open_output_stream(header) as f:
            f.write(json.dumps({"rows": n, "components": parts[0][3] if parts else 0, "parts": listed}, indent=1).encode())
        for p in before:
            store.delete_file(p)

    def abort(self, messages) -> None:
        store, at = _store(self.path)
        for name in (x[0] for m in messages if m for x in m.parts):
            store.delete_file(f"{at}/{name}")


class FileWriter(MatrixWriter):
    """Tasks write their rows at their places in one file, which gets its header and its name last. The store must let them, as mounted ones do."""

    def __init__(self, path: str, block: int, overwrite: bool):
        super().__init__(path, block, overwrite)
        self.name = f".vectors-{uuid.uuid4().hex}"

    def place(self, store: fs.FileSystem, at: str, first: int, m: np.ndarray) -> str:
        with os.fdopen(os.open(f"{at}/{self.name}", os.O_WRONLY | os.O_CREAT, 0o644), "wb") as f:
            f.seek(LEAD + first * m.shape[1] * 4)
            f.write(m.data)
        return self.name

    def commit(self, messages) -> None:
        _, at = _store(self.path)
        parts, n = self.ordered(messages)
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (n, parts[0][3] if parts else 0)})
        if len(head.getvalue()) != LEAD:
            raise ValueError(f"the header has {len(head.getvalue())} bytes, not {LEAD}")
        os.makedirs(at, exist_ok=True)
        with os.fdopen(os.open(f"{at}/{self.name}", os.O_WRONLY | os.O_CREAT, 0o644), "wb") as f:
            f.write(head.getvalue())
        os.replace(f"{at}/{self.name}", f"{at}/vectors.npy")

    def abort(self, messages) -> None:
        at = f"{_store(self.path)[1]}/{self.name}"
        if os.path.exists(at):
            os.remove(at)


class MatrixSource(DataSource):
    """Format "matrix": (row_index, vector) of a .npy file or a folder of them; options `block`, the bytes of a part, and `single`, to write one file."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("block", BLOCK)))

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        kind = FileWriter if self.options.get("single", "false").lower() == "true" else MatrixWriter
        if kind is FileWriter and not isinstance(_store(self.options["path"])[0], fs.LocalFileSystem):
            raise ValueError("one file is written to mounted folders only: write parts")
        return kind(self.options["path"], int(self.options.get("block", BLOCK)), overwrite)


def _known(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(MatrixSource)


def read_matrix(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(row_index, vector) of .npy matrices of numbers, by ranges of rows; pickled objects are refused.

    Rows of a folder that write_matrix made are numbered through all parts, those
    of other files in each. A matrix stored by columns is read by one task.
    """
    _known(spark)
    return spark.read.format("matrix").option("block", block).load(path)


def write_matrix(df: DataFrame, id_col: str, vector_col: str, folder: str, single: bool = False, block: int = BLOCK) -> int:
    """df in the order of its identifiers: a matrix of 32-bit floats, and its identifiers (row_index, identifier) as TSV; the number of rows.

    The matrix is parts, each a file for numpy, and their list `matrix.json`; or one
    file `vectors.npy`, which takes a folder that the executors have mounted. Any
    number of rows. Vectors are of one length and not null.
    """
    _known(df.sparkSession)
    numbered = settled(with_running(df.select(id_col, vector_col), [id_col]), "matrix-rows")
    rows = numbered.selectExpr("`index` - 1 AS row_index", f"CAST(`{vector_col}` AS array<float>) AS vector")
    rows.sortWithinPartitions("row_index").write.format("matrix").option("block", block).option("single", single).mode("overwrite").save(folder)
    numbered.selectExpr("`index` - 1 AS row_index", f"`{id_col}`").write.mode("overwrite").option("header", True).option("sep", "\t").option("emptyValue", "").csv(f"{folder}/ids.tsv")
    return numbered.count()
