"""Files that tasks write themselves, on any file system that Arrow knows, under a name that they get when whole."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path that all executors reach, and the path in it."""
    plain = re.sub(r"^file:/+", "/", path)
    return (pyarrow.fs.LocalFileSystem(), plain) if plain.startswith("/") else pyarrow.fs.FileSystem.from_uri(plain)


def removed(path: str, fs: pyarrow.fs.FileSystem | None = None) -> None:
    """Remove a file if it is there."""
    fs, path = (fs, path) if fs else place(path)
    if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
        fs.delete_file(path)


class FileInWork:
    """A Parquet file that gets its name once it is whole."""

    def __init__(self, path: str, schema: pa.Schema, rows: int = 1 << 16):
        self.rows = rows
        self.fs, self.path = place(path)
        folder, _, name = self.path.rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        self.temp = f"{folder}/_{name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.temp)
        self.writer = pq.ParquetWriter(self.stream, schema, compression="snappy")
        self.held, self.n_held, self.n = [], 0, 0

    def add(self, t: pa.Table) -> None:
        self.held.append(t)
        self.n_held += len(t)
        self.n += len(t)
        if self.n_held >= self.rows:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.concat_tables(self.held), row_group_size=self.rows)
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self.flush()
        self.writer.close()
        self.stream.close()
        if not isinstance(self.fs, pyarrow.fs.LocalFileSystem):
            removed(self.path, self.fs)
        self.fs.move(self.temp, self.path)

    def abort(self) -> None:
        try:
            self.stream.close()
            self.fs.delete_file(self.temp)
        except OSError:
            pass
