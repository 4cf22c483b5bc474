"""Python data source "npy": NumPy array files, read as rows and written by tasks with a commit on the driver.

Reading. Options: path (a file, or a folder of .npy files; a path or URI). Every file is split into ranges of about ``split_rows`` rows (default 2**16) along its
first axis; a task seeks to its range and reads no more. Rows are (file, i, values): one-dimensional arrays have one value a row, others
their row, flattened. Files whose names begin with "_" or "." are not seen. No pickles.

Writing. Rows of (i, values) or (name, values): every task writes arrays below ``_pending-<uuid>`` in the folder, float64 or, with option dtype, float32. Without
names a task's rows become one two-dimensional array, part-<partition>-<uuid>.npy, in order; with names every row becomes a file of its own, as
one dumps single samples. Only when all tasks are done does the driver move the files into place; if one fails, all are deleted. So
no reader sees a file of a task that failed or was run twice, and a job that dies leaves at most a folder that is not seen.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from plumbline.sources.files import file_system, list_files, open_uri

PENDING = "_pending-"


def header(f) -> tuple[tuple[int, ...], object, int]:
    """(shape, dtype, where the data begins) of an .npy file; only arrays in row order, of plain numbers."""
    import numpy as np

    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if dtype.kind not in "biuf" or fortran and len(shape) > 1:
        raise ValueError(f"npy: {dtype} in {'column' if fortran else 'row'} order is not read")
    return shape, dtype, f.tell()


class NpyPart(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))


class NpyReader(DataSourceReader):
    def __init__(self, path: str, split_rows: int):
        self.path, self.split_rows = path, split_rows

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in list_files(self.path):
            name = p.rsplit("/", 1)[-1]
            if p != self.path and (not name.endswith(".npy") or name[0] in "_."):
                continue
            with open_uri(p) as f:
                n = (header(f)[0] or (1,))[0]
            out += [NpyPart(p, k, min(n, k + self.split_rows)) for k in range(0, n, self.split_rows)]
        return out

    def read(self, partition: NpyPart | None) -> Iterator[tuple]:
        import numpy as np

        if partition is None:  # no partitions at all
            return
        path, start, stop = partition.value
        with open_uri(path) as f:
            shape, dtype, begin = header(f)
            width = int(np.prod(shape[1:], dtype=np.int64))
            f.seek(begin + start * width * dtype.itemsize)
            size = (stop - start) * width * dtype.itemsize
            data = f.read(size)
        if len(data) != size:
            raise ValueError(f"npy: {path} ends early")
        rows = np.frombuffer(data, dtype=dtype).reshape(stop - start, width).astype(np.float64)
        name = path.rsplit("/", 1)[-1]
        for k, row in enumerate(rows.tolist(), start):
            yield name, k, row


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class NpyWriter(DataSourceWriter):
    def __init__(self, schema: StructType, folder: str, overwrite: bool, dtype: str):
        self.columns = [f.name for f in schema.fields]
        if len(self.columns) != 2 or self.columns[1] != "values" or self.columns[0] not in ("i", "name"):
            raise ValueError(f"npy: rows are (i, values) or (name, values), not {self.columns}")
        if dtype not in ("float64", "float32"):
            raise ValueError(f"npy: {dtype} is not written")
        self.folder, self.overwrite, self.dtype, self.pending = folder.rstrip("/"), overwrite, dtype, f"{PENDING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        import numpy as np
        from pyspark import TaskContext

        fs, top = file_system(self.folder)
        top = f"{top}/{self.pending}"
        fs.create_dir(top, recursive=True)
        attempt, names = uuid.uuid4().hex, []

        def put(name: str, array) -> None:
            out = io.BytesIO()
            np.save(out, array, allow_pickle=False)
            with fs.open_output_stream(f"{top}/{name}.{attempt}") as f:  # an attempt's files are its own
                f.write(out.getbuffer())
            names.append(f"{name}.{attempt}")

        rows = []
        for key, values in iterator:
            if values is None:
                raise ValueError(f"npy: no values for {key}")
            if self.columns[0] == "name":
                if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._=-]*", str(key)):
                    raise ValueError(f"npy: {key!r} is no file name")
                put(f"{key}.npy", np.array(values, dtype=self.dtype))
            else:
                rows.append(values)
        if rows:
            put(f"part-{TaskContext.get().partitionId():05d}-{attempt}.npy", np.array(rows, dtype=self.dtype))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, top = file_system(self.folder)
        names = [n for m in messages if m is not None for n in m.names]
        final = [n.rsplit(".", 1)[0] for n in names]
        if len(set(final)) != len(final):
            self.abort(messages)
            raise ValueError("npy: two rows have one name")
        fs.create_dir(top, recursive=True)
        if self.overwrite:
            for i in fs.get_file_info(FileSelector(top)):
                if i.type == FileType.File and i.path.endswith(".npy"):
                    fs.delete_file(i.path)
        for n, to in zip(names, final):
            fs.move(f"{top}/{self.pending}/{n}", f"{top}/{to}")
        if names:
            fs.delete_dir(f"{top}/{self.pending}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = file_system(self.folder)
        fs.delete_dir_contents(f"{top}/{self.pending}", missing_dir_ok=True)
        fs.delete_dir(f"{top}/{self.pending}") if fs.get_file_info(f"{top}/{self.pending}").type.name == "Directory" else None


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, i long, `values` array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options["path"], int(self.options.get("split_rows", 1 << 16)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NpyWriter(schema, self.options["path"], overwrite, self.options.get("dtype", "float64"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyDataSource)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("npy").options(path=path, **options).load()


def write(rows: DataFrame, folder: str, mode: str = "append", **options: str) -> None:
    """Write (i, values) or (name, values); append adds files, overwrite replaces the folder's arrays once all tasks are done."""
    register(rows.sparkSession)
    rows.write.format("npy").mode(mode).options(path=folder, **options).save()
