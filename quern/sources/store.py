"""Small files of any file system that Spark reads, from the driver: manifests, listings, moves."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """The files below one folder, by names relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._at(name))

    def empty(self) -> bool:
        """Whether there is nothing here, or an empty folder."""
        return not self.exists() or self._files.getFileStatus(self._at()).isDirectory() and not len(self._files.listStatus(self._at()))

    def listing(self) -> list[tuple[str, int, int]]:
        """(name, bytes, time of change) of every file below, hidden ones aside, sorted; of the root itself if it is a file."""
        if not self.exists():
            return []
        whole = self._files.makeQualified(self._at()).toUri().getPath()
        found, out = self._files.listFiles(self._at(), True), []
        while found.hasNext():
            held = found.next()
            name = held.getPath().toUri().getPath()[len(whole) :].lstrip("/")
            if not any(part.startswith((".", "_")) for part in name.split("/")):
                out.append((name, held.getLen(), held.getModificationTime()))
        return sorted(out)

    def linked(self, name: str) -> bool:
        """Whether a name or the folder it is in is a symbolic link."""
        parts = name.split("/")
        return any(self._files.getFileLinkStatus(self._at("/".join(parts[: i + 1]))).isSymlink() for i in range(len(parts)))

    def read(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, content: str | bytes) -> None:
        out = self._files.create(self._at(name), False)
        try:
            out.write(bytearray(content.encode() if isinstance(content, str) else content))
        finally:
            out.close()

    def delete(self) -> None:
        self._files.delete(self._at(), True)

    def publish(self, target: Store) -> None:
        """Move this folder to where ``target`` is, which must be empty: readers see all of it or nothing."""
        if not target.empty():
            raise FileExistsError(f"{target.root} isn't empty")
        target.delete()
        if not self._files.rename(self._at(), target._at()):
            raise FileExistsError(f"{target.root} can't be published")
