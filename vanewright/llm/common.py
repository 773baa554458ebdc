"""Shared helpers: scratch tables in the cluster's shared folder, portable file access, word hashing."""

from __future__ import annotations

import atexit
import mmap
import os
import re
import sys
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this subpackage (ASCII blanks).
BLANKS = r"\x20\x09-\x0D"
WORD_GAP = f"[{BLANKS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else (local sessions only) an own one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        else:
            path = "file://" + tempfile.mkdtemp(prefix="vanewright-")
            spark.sparkContext.setCheckpointDir(path)
            atexit.register(_remove_local, path)
    return path.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


class Scratch:
    """Written tables that cut lineage. They live in the shared folder, so a lost executor loses none of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self._cleanup)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                fs, p = self._fs(path)
                fs.delete(p, True)

    def _cleanup(self) -> None:
        try:
            fs, p = self._fs(self.root)
            fs.delete(p, True)
        except Exception:  # the session is gone already: nothing is left to talk to
            pass


def open_store(path: str):
    """(pyarrow filesystem, path inside it) of a shared folder given as URI or plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


#: Mappings need no open file, and there can be thousands.
_NO_FD = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def mapped(path: str, dtype) -> np.ndarray:
    """Memory-map a binary file of the shared folder; a remote one is fetched once to the executor's file root."""
    from pyarrow import fs

    store, inner = open_store(path)
    if not isinstance(store, fs.LocalFileSystem):
        local = os.path.join(SparkFiles.getRootDirectory(), "mapped-" + xxhash.xxh3_64_hexdigest(path))
        if not os.path.exists(local):
            part = f"{local}.{uuid.uuid4().hex}"
            fs.copy_files(inner, part, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            os.replace(part, local)
        inner = local
    with open(inner, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            return np.zeros(0, dtype)
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_NO_FD), dtype)


def write_bytes(path: str, data) -> None:
    """Write a file to the shared folder; a repeated or speculative task replaces it whole by the same content."""
    from pyarrow import fs

    store, inner = open_store(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    if isinstance(store, fs.LocalFileSystem):
        os.replace(part, inner)
    else:
        store.move(part, inner)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased (``bytes`` methods touch ASCII only)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


_xxh = xxhash.xxh3_64_intdigest


def hashes(items: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings."""
    return np.fromiter(map(_xxh, items), np.uint64, len(items))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply), in place on a fresh array."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: A key is common if it has more than one in so many rows; there are fewer common keys than this.
COMMON = 10_000


def is_common(size: Column, total: int) -> Column:
    return size * COMMON > total


def join_keys(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows joined with a table of their keys that has a boolean column ``common``: common keys are broadcast (there are
    at most COMMON of them), so that no key's rows have to be dealt to one task; all others meet by a shuffle."""
    common = F.broadcast(table.where("common"))
    return rows.join(common, key).union(rows.join(common.select(*key), key, "left_anti").join(table.where("not common").hint("merge"), key))


#: Rows of a batch of texts: texts can be long, and a batch is held by the JVM (by Parquet's reader and by Arrow) and by
#: its Python worker.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Texts are read, and handed to Python, in small batches; a smaller setting of the session stays."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
