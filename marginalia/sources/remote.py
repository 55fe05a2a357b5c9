"""Folders on any file system Spark can reach, with the few methods of a path that the stores use."""

from __future__ import annotations

from pyspark.sql import SparkSession


class RemotePath:
    """A path given as a URI. Every method goes through the Hadoop file system of the active session, so what the driver writes
    is where the executors look."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def __truediv__(self, name: str) -> RemotePath:
        return RemotePath(f"{self.uri}/{name}")

    def __str__(self) -> str:
        return self.uri

    def __eq__(self, other: object) -> bool:
        return str(self) == str(other)

    def __hash__(self) -> int:
        return hash(self.uri)

    @property
    def parent(self) -> RemotePath:
        return RemotePath(self.uri.rpartition("/")[0])

    @property
    def _at(self) -> tuple:
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError(f"no session to reach {self.uri} with")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        return spark, path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        _, fs, path = self._at
        return fs.exists(path)

    def is_dir(self) -> bool:
        _, fs, path = self._at
        return fs.exists(path) and fs.getFileStatus(path).isDirectory()

    def mkdir(self, parents: bool = True, exist_ok: bool = True) -> None:
        _, fs, path = self._at
        fs.mkdirs(path)

    def remove(self) -> None:
        _, fs, path = self._at
        fs.delete(path, True)

    def unlink(self) -> None:
        self.remove()

    def read_text(self, encoding: str = "utf-8") -> str:
        spark, fs, path = self._at
        if not fs.exists(path):
            raise FileNotFoundError(self.uri)
        stream = fs.open(path)
        try:
            return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(encoding)
        finally:
            stream.close()

    def write_text(self, text: str, encoding: str = "utf-8") -> None:
        _, fs, path = self._at
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode(encoding)))
        finally:
            stream.close()
