"""Token ids as Arrow IPC files of fixed-size-list batches.

Texts are ranged by ``doc_id`` (ties: text hash, then text), encoded in that
order and followed by the end id. Each task writes one shard: the ids of its
documents end to end, cut into sequences of ``length`` ids. A shard has the
columns ``ids`` (fixed_size_list<uint16>) and ``mask`` (fixed_size_list<bool>,
false on the padding of the last sequence), uncompressed, so a memory map gives
any sequence without copying; ``*.index.arrow`` has doc_id, start, n_tokens of its
documents. Shards go to the folder that the cluster shares, by pyarrow's file
systems; each attempt of a task writes files of its own name, and only those that the
committed manifest names count, so lost tasks can run again.

Defined cases: a null or empty text is its end id alone; rows without ``doc_id``
come first; rows that repeat a ``doc_id`` stand side by side; no document, no
shard; extra columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recoflow.llm import common as C
from recoflow.llm import tokens as T

END_ID = 2
LENGTH = 2048
BATCH = 512  # sequences of a record batch
MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _sequence_batch(ids: np.ndarray, n: int, schema: pa.Schema) -> pa.RecordBatch:
    length = schema.field("ids").type.list_size
    rows = -(-n // length)
    flat = np.zeros(rows * length, np.uint16)
    flat[:n] = ids
    mask = np.arange(rows * length) < n
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), length),
                            pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema)


def _writer(folder: str, path: str, length: int, end_id: int):
    def run(batches):
        shard = TaskContext.get().partitionId()
        schema = pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        enc, end = T.encoder(path), np.array([end_id], "<u2").tobytes()
        fs, root = file_system(folder)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
        sink = out = None
        starts, total, n_docs, rest = [], 0, 0, b""
        for b in batches:
            for i, j, data, offs in C.chunks(b.column("text")):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{name}.arrow")
                    out = pa.ipc.new_file(sink, schema)
                raw = data.tobytes()
                ids = [x + end for x in enc.encode([raw[offs[k]:offs[k + 1]] for k in range(j - i)])]
                sizes = np.array([len(x) // 2 for x in ids], np.int64)
                starts.append(pa.record_batch([b.column("doc_id")[i:j], pa.array(total + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=index))
                total += int(sizes.sum())
                n_docs += j - i
                rest = b"".join([rest, *ids])
                step = 2 * length * BATCH
                while len(rest) >= step:
                    out.write_batch(_sequence_batch(np.frombuffer(rest[:step], "<u2"), step // 2, schema))
                    rest = rest[step:]
        if out is None:
            return
        if rest:
            out.write_batch(_sequence_batch(np.frombuffer(rest, "<u2"), len(rest) // 2, schema))
        out.close()
        sink.close()
        with fs.open_output_stream(f"{name}.index.arrow") as s, pa.ipc.new_file(s, index) as w:
            for x in starts:
                w.write_batch(x)
        yield pa.record_batch({"shard": pa.array([shard], pa.int64()), "path": pa.array([name]), "n_docs": pa.array([n_docs], pa.int64()),
                               "n_tokens": pa.array([total], pa.int64())})
    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Writes the shards and ``folder/manifest``; the manifest (one row a shard) is returned."""
    path = path or T.vocabulary_path()
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text"))
     .withColumn("tie", F.xxhash64("text"))
     .repartitionByRange("doc_id", "tie")
     .sortWithinPartitions("doc_id", "tie", "text").drop("tie")
     .mapInArrow(_writer(folder, path, length, end_id), MANIFEST)
     .write.mode("overwrite").parquet(f"{folder}/manifest"))
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class TokenFile:
    """Random access to one shard: ``file.sequence(k)``, ``file.mask(k)``, ``file.ids(start, n)``."""

    def __init__(self, path: str):
        fs, name = file_system(path)
        self.source = pa.memory_map(f"{name}.arrow") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(f"{name}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        with fs.open_input_file(f"{name}.index.arrow") as s:
            self.index = pa.ipc.open_file(s).read_all()

    def _flat(self, k: int, column: int) -> pa.Array:
        return self.file.get_batch(k).column(column).flatten()

    def sequence(self, k: int) -> np.ndarray:
        at = (k % BATCH) * self.length
        return self._flat(k // BATCH, 0).to_numpy(zero_copy_only=True)[at:at + self.length]

    def mask(self, k: int) -> pa.Array:
        return self._flat(k // BATCH, 1).slice((k % BATCH) * self.length, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        step, out = BATCH * self.length, []
        while n:
            k, at = divmod(start, step)
            part = self._flat(k, 0).to_numpy(zero_copy_only=True)[at:at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(out) if len(out) != 1 else out[0]


def _read_back(batches):
    for b in batches:
        for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
            f = TokenFile(path)
            for part in f.index.to_batches(max_chunksize=4096):
                starts, sizes = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                crc = [zlib.crc32(f.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist())]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "start": pa.array(starts + base), "n_tokens": part.column("n_tokens"),
                                       "ids_crc32": pa.array(crc, pa.int64())})


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start over all shards, n_tokens, crc32 of its ids."""
    # one row a shard: the running total is over as many rows as there are files
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(n, "shard").select("path", "base").mapInArrow(_read_back, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{C.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(C.documents(spark, sf_dir), folder))
