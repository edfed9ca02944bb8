"""A versioned store of immutable Parquet parts.

A table is a list of part directories; a write adds directories and never
changes one.  What the tables are is in a catalog, a small JSON document, and each commit writes the
next numbered catalog file, which must not exist yet: a commit is atomic, two
writers cannot both have the same number, and a crash leaves the last
catalog in force.  The file is written under another name and then given its own by an operation of the file system that
fails if the name is taken: a link on local disks, a rename on those in ``EXCLUSIVE``.  On other stores, whose rename
is a copy or replaces what is there, a durable store is refused unless ``single_writer`` says that nobody else writes.

With a ``key`` (16, 24 or 32 bytes) the values of all columns are stored as AES-GCM ciphertext.  Filters then do
not reach the scan; names, types, numbers of rows and the rows' identities are not hidden.
"""

from __future__ import annotations

import copy
import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StorageError, TransactionError

BATCH, ROW = "__batch", "__row"
HIDDEN = (BATCH, ROW)
#: File systems whose rename is one step and fails if the target exists.
EXCLUSIVE = ("hdfs", "viewfs", "abfs", "abfss")
#: Seconds for which files that no catalog names are kept: another writer may be about to commit them.
GRACE = 3600.0
#: Catalogs before the last that a vacuum keeps.
CATALOGS = 10
EMPTY = {"databases": {"main": {"tables": {}, "views": {}}}}


class Files:
    """Small files and folders on a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._utils = jvm.org.apache.hadoop.fs.FileUtil
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)
        self.jvm = jvm

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        found = sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []
        return [n for n in found if not n.startswith(".")]

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    @property
    def scheme(self) -> str:
        return self.fs.getUri().getScheme()

    def create(self, path: str, text: str) -> None:
        """Writes a new file in one step; fails if it exists."""
        folder, _, name = path.rpartition("/")
        aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.scheme == "file":
                at = [self.jvm.java.io.File(re.sub(r"^file:/*", "/", x)).toPath() for x in (path, aside)]
                self.jvm.java.nio.file.Files.createLink(*at)
            elif self.exists(path) or not self.fs.rename(self._path(aside), self._path(path)):
                raise StorageError(f"{path} exists")
        finally:
            self.remove(aside)

    def older(self, path: str, seconds: float) -> bool:
        """Whether a file, or the newest one of a folder, was written more than so many seconds ago."""
        times = [s.getModificationTime() for s in (self.fs.getFileStatus(self._path(path)), *self.fs.listStatus(self._path(path)))]
        return time.time() - max(times) / 1000 >= seconds

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def copy(self, source: str, target: str) -> None:
        a, b = self._path(source), self._path(target)
        self._utils.copy(a.getFileSystem(self.conf), a, b.getFileSystem(self.conf), b, False, False, self.conf)

    def rename(self, source: str, target: str) -> None:
        if not self.fs.rename(self._path(source), self._path(target)):
            raise StorageError(f"cannot rename {source} to {target}")


class Store:
    def __init__(self, spark: SparkSession, root: str, compression: str = "zstd", durable: bool = True, single_writer: bool = False, key: bytes | None = None):
        self.spark, self.root, self.compression, self.durable, self.key = spark, root.rstrip("/"), compression, durable, key
        self.files = Files(spark, root)
        if durable and not single_writer and self.files.scheme not in ("file", *EXCLUSIVE):
            raise StorageError(f"{self.files.scheme} cannot keep two writers apart; say single_writer=True if there is one")
        self.number, self.state = 0, copy.deepcopy(EMPTY)
        if durable:
            self.refresh()

    # catalog

    def refresh(self) -> None:
        """Takes over the last committed catalog."""
        found = [n for n in self.files.names(f"{self.root}/_catalog") if n.endswith(".json")]
        if found and int(found[-1][:-5]) != self.number:
            self.number = int(found[-1][:-5])
            self.state = json.loads(self.files.read(f"{self.root}/_catalog/{found[-1]}"))

    def commit(self) -> None:
        if self.durable:
            path = f"{self.root}/_catalog/{self.number + 1:012d}.json"
            try:
                self.files.create(path, json.dumps(self.state))
            except Exception as e:
                raise TransactionError("another writer has committed since; nothing was written") from e
        self.number += 1

    def snapshot(self) -> dict:
        return copy.deepcopy(self.state)

    # parts

    def next_batch(self) -> int:
        self.state["batch"] = self.state.get("batch", 0) + 1
        return self.state["batch"]

    def write(self, df: DataFrame, database: str, table: str) -> str:
        """A new part with the rows of ``df``; it is in no table yet."""
        part = f"{database}/{table}/{uuid.uuid4().hex}"
        if self.key is not None:
            key = F.lit(self.key)
            hidden = {f.name: F.col(f"`{f.name}`") if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if f.name not in HIDDEN}
            df = df.withColumns({n: F.aes_encrypt(c, key) for n, c in hidden.items()})
        df.write.option("compression", self.compression).parquet(f"{self.root}/{part}")
        return part

    def read(self, parts: list[str], schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(ROW, T.LongType())])
        if not parts:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.root}/{p}" for p in parts]
        if self.key is None:
            return self.spark.read.schema(full).parquet(*paths)
        stored = T.StructType([f if f.name in HIDDEN else T.StructField(f.name, T.BinaryType()) for f in full.fields])
        rows = self.spark.read.schema(stored).parquet(*paths)
        plain = {f.name: F.aes_decrypt(F.col(f"`{f.name}`"), F.lit(self.key)) for f in schema.fields}
        return rows.select(*[F.col(f.name) if f.name in HIDDEN else (plain[f.name] if isinstance(f.dataType, T.BinaryType) else plain[f.name].cast("string").cast(f.dataType)).alias(f.name) for f in full.fields])

    def vacuum(self, grace: float = GRACE) -> int:
        """Removes parts and held rows that the catalog in force does not name and that are older than ``grace`` seconds; the number removed.

        Of old catalogs the last ``CATALOGS`` stay."""
        if self.durable:
            self.refresh()
        used = {p["path"] for d in self.state["databases"].values() for t in d["tables"].values() for p in t["parts"]}
        folders = [f"{d}/{t}" for d in self.state["databases"] for t in self.files.names(f"{self.root}/{d}")] + ["_aside"]
        gone = 0
        for folder in folders:
            for part in self.files.names(f"{self.root}/{folder}"):
                path = f"{self.root}/{folder}/{part}"
                if f"{folder}/{part}" not in used and self.files.older(path, grace):
                    self.files.remove(path)
                    gone += 1
        for name in self.files.names(f"{self.root}/_catalog")[: -1 - CATALOGS]:
            if self.files.older(f"{self.root}/_catalog/{name}", grace):
                self.files.remove(f"{self.root}/_catalog/{name}")
        return gone

    def backup(self, target: str) -> None:
        """A copy of the committed store in an empty folder: under a temporary name first."""
        files = Files(self.spark, target)
        if files.names(target):
            raise StorageError(f"{target} is not empty")
        aside = f"{target.rstrip('/')}-{uuid.uuid4().hex}"
        used = {p["path"] for d in self.state["databases"].values() for t in d["tables"].values() for p in t["parts"]}
        for part in sorted(used):
            self.files.copy(f"{self.root}/{part}", f"{aside}/{part}")
        files.create(f"{aside}/_catalog/{max(1, self.number):012d}.json", json.dumps(self.state))
        files.remove(target)
        files.rename(aside, target)
