"""The shared work folder and whole-file writes through Hadoop's file systems."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a local folder is made only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="glyphmark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """Hadoop's view of a path, so that any store Spark can write takes the files."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.path = self.at(path)
        self.fs = self.path.getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def replace(self, part) -> None:
        """Puts `part` in place of the path in one rename."""
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.fs.makeQualified(part), self.fs.makeQualified(self.path), options)

    def write(self, data: bytes) -> None:
        """Readers see the old file or the new one, never a piece."""
        part = self.at(f"{self.path}.{uuid.uuid4().hex}.part")
        try:
            stream = self.fs.create(part, True)
            try:
                stream.write(data)
            finally:
                stream.close()
            self.replace(part)
        finally:
            self.fs.delete(part, False)

    def join(self, folder: str) -> None:
        """The part files of a folder, in the order of their numbers, as one file; streamed, never held."""
        part = self.at(f"{self.path}.{uuid.uuid4().hex}.part")
        try:
            stream = self.fs.create(part, True)
            try:
                source = self.at(folder)
                store = source.getFileSystem(self.conf)
                parts = [s.getPath() for s in store.listStatus(source) if s.getPath().getName().startswith("part-")]
                for name in sorted(parts, key=lambda p: int(p.getName().split("-")[1])):
                    piece = store.open(name)
                    try:
                        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, stream, self.conf, False)
                    finally:
                        piece.close()
            finally:
                stream.close()
            self.replace(part)
        finally:
            self.fs.delete(part, False)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    files = Files(spark, folder)
    return sorted(s.getPath().getName() for s in files.fs.listStatus(files.path)) if files.exists() else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    Files(spark, path).write(text.encode())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if it isn't there."""
    files = Files(spark, path)
    if not files.exists():
        return None
    stream = files.fs.open(files.path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def move(spark: SparkSession, path: str, to: str) -> None:
    files = Files(spark, path)
    if not files.fs.rename(files.path, files.at(to)):
        raise OSError(f"{path} can't be moved to {to}")


def remove(spark: SparkSession, path: str) -> None:
    files = Files(spark, path)
    files.fs.delete(files.path, True)


def write_json(spark: SparkSession, value, path: str) -> None:
    """One document, keys sorted, replaced atomically."""
    Files(spark, path).write((json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode())
