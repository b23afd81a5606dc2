"""Byte files in the shared folder, for what Spark's writers cannot write: archives, index blocks, fragments."""

from __future__ import annotations

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system (local, HDFS, object stores) and path of a folder's or file's address."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Writer:
    """Writes one file; its name is new for each attempt of a task, so that a retry cannot change what others refer to."""

    def __init__(self, folder: str, name: str):
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        self.name, self.at = name, 0
        self.stream = system.open_output_stream(f"{path}/{name}", compression=None)

    def write(self, data: bytes) -> tuple[int, int]:
        """Appends; returns offset and length."""
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.stream.close()


class Reader:
    """Range reads in the files of one folder; the last few files stay open."""

    def __init__(self, folder: str, most: int = 16):
        self.system, self.path = filesystem(folder)
        self.most, self.open = most, {}

    def file(self, name: str):
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.system.open_input_file(f"{self.path}/{name}")
        return self.open[name]

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self.file(name).read_at(length, offset)

    def stream(self, name: str, chunk: int = 1 << 20):
        with self.system.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            while data := f.read(chunk):
                yield data
