"""A store of small objects over any file system that Spark can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class ObjectStore:
    """get, put, create, delete, list and exists under a root URI (file, hdfs, s3a, ...)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        top = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.uri = str(self._fs.makeQualified(top).toString())

    def path(self, key: str) -> str:
        return f"{self.root}/{key}" if key else self.root

    def _at(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(key))

    def exists(self, key: str) -> bool:
        return bool(self._fs.exists(self._at(key)))

    def get(self, key: str) -> bytes:
        stream = self._fs.open(self._at(key))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _write(self, key: str, data: bytes, replace: bool) -> None:
        stream = self._fs.create(self._at(key), replace)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def put(self, key: str, data: bytes) -> None:
        """Write under another name, then rename: readers see the old or the new object."""
        part = f"{key}.{uuid.uuid4().hex}.part"
        self._write(part, data, True)
        if not self._fs.rename(self._at(part), self._at(key)):
            self._fs.delete(self._at(key), False)
            if not self._fs.rename(self._at(part), self._at(key)):
                raise OSError(f"cannot rename to {self.path(key)}")

    def create(self, key: str, data: bytes) -> bool:
        """Write if no such object is there yet. Of several writers one gets True.

        File systems rename without replacing; S3, where a rename is a copy, writes on the
        condition that the object isn't there, and refuses where that is not supported.
        """
        if self.exists(key):
            return False
        if self.uri.startswith(("s3a:", "s3:")):
            return self._create_on_condition(key, data)
        part = f"{key}.{uuid.uuid4().hex}.part"
        self._write(part, data, True)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(self._at(part)), self._fs.makeQualified(self._at(key)), none)
        except Exception as why:
            self._fs.delete(self._at(part), False)
            if "FileAlreadyExists" in str(why):
                return False
            raise
        return True

    def _create_on_condition(self, key: str, data: bytes) -> bool:
        builder = self._fs.createFile(self._at(key)).overwrite(False).recursive()
        try:
            stream = builder.must("fs.option.create.conditional.overwrite", True).build()
            try:
                stream.write(bytearray(data))
            finally:
                stream.close()
        except Exception as why:
            if any(name in str(why) for name in ("FileAlreadyExists", "RemoteFileChanged", "412")):
                return False
            raise
        return True

    def delete(self, key: str) -> None:
        """Deleting what is not there is no error."""
        self._fs.delete(self._at(key), True)

    def list(self, prefix: str = "") -> list[str]:
        """Keys of all objects under a prefix, in order."""
        if not self.exists(prefix):
            return []
        found, files = [], self._fs.listFiles(self._at(prefix), True)
        base = self.uri.rstrip("/") + "/"
        while files.hasNext():
            name = str(files.next().getPath().toString())
            found.append(name.removeprefix(base))
        return sorted(f for f in found if not f.rpartition("/")[2].startswith(".") and not f.endswith(".part"))
