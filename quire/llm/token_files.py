"""Operator 6: token ids in Arrow stream files of fixed-size lists.

Documents are dealt to shards by ranges of doc_id. A shard is one stream file; each of its batches has
`batch_rows` sequences of `seq_len` ids, with a mask that is false on the filling after the shard's last id. Ids take 16 bits where
the vocabulary fits.
All batches but the last have one layout, so a reader maps the file and reaches any sequence without a copy.
A task writes under a name of its own and reports it, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.shared import n_parts, new_folder, staged
from quire.llm.tokens import encoder, tokenizer_path

SEQ_LEN, BATCH_ROWS = 2048, 256
_INDEX = "shard int, file string, place long, doc_id long, at long, n_tokens long"


class ShardWriter:
    """Writes ids one text after another as (ids, mask) sequences."""

    def __init__(self, path: str, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS, n_vocab: int = 1 << 32):
        self.kind = pa.uint16() if n_vocab <= 1 << 16 else pa.uint32()
        self.seq_len, self.full = seq_len, seq_len * batch_rows
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        fs, where = pafs.FileSystem.from_uri(path)
        fs.create_dir(where.rpartition("/")[0])
        self.sink = fs.open_output_stream(where)
        self.writer = pa.ipc.new_stream(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n += len(ids)
        if self.n_waiting >= self.full:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.full * self.full
            for i in range(0, whole, self.full):
                self._batch(ids[i : i + self.full], self.full)
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = pa.array(np.arange(len(ids)) < n)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.seq_len) for x in (pa.array(ids.astype(self.kind.to_pandas_dtype(), copy=False)), mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:
            ids = np.concatenate(self.waiting)
            self._batch(np.append(ids, np.zeros(-len(ids) % self.seq_len, np.uint32)), len(ids))
        self.writer.close()
        self.sink.close()


class ShardReader:
    """Views of a shard. All batches but the last have one layout, so each is read from its own place: mapped where the file is local."""

    def __init__(self, path: str):
        fs, where = pafs.FileSystem.from_uri(path)
        self.file = pa.memory_map(where) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(where)
        self.schema = pa.ipc.open_stream(self.file).schema
        self.first = self.file.tell()
        self.seq_len = self.schema.field(0).type.list_size
        self.last = (-1, None)
        self.n_bytes = self.step = 0
        self.step = len(self._batch(0).column(0).flatten())
        self.n_bytes = self.file.tell() - self.first

    def _batch(self, i: int) -> pa.RecordBatch:
        if self.last[0] != i:
            self.file.seek(self.first + i * self.n_bytes)
            self.last = i, pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of a sequence."""
        b, row = divmod(i * self.seq_len, self.step)
        own = self._batch(b)
        return own.column(0).flatten().to_numpy()[row : row + self.seq_len], own.column(1)[row // self.seq_len].values

    def ids(self, at: int, n: int) -> np.ndarray:
        """n ids from place `at` of the shard on."""
        out = []
        while n:
            b, i = divmod(at, self.step)
            out.append(self._batch(b).column(0).flatten().to_numpy()[i : i + n])
            at, n = at + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS, shard_mb: int = 256) -> DataFrame:
    """Write the shards and give their index: shard, file, place, doc_id, at (ids before it in the shard), n_tokens.

    Null text counts as empty; each document ends with id 0. Rows with a null doc_id come first. Rows that
    repeat a doc_id are written each for itself, in the order of a hash of their texts, so that they may fill several
    shards. No rows give no files. Whole texts of any length are encoded. Other columns of docs are not read. Shards
    hold about shard_mb of text or less; there are as many as shuffle partitions at least.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, place = TaskContext.get().partitionId(), None, 0
        file = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.arrows"
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or ShardWriter(file, seq_len, batch_rows, encoder(path).lib.get_vocab_size())
            at, n = [], []
            for _, ids in encoder(path).column(batch.column(1)):
                at.append(out.n)
                n.append(len(ids))
                out.add(ids)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int32()), pa.array([file] * k), pa.array(range(place, place + k), pa.int64()), batch.column(0), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=[x.split()[0] for x in _INDEX.split(", ")])
            place += k
        if out:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(n_parts(docs.sparkSession), -(-n_bytes // (shard_mb << 20)))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return staged(rows.mapInArrow(run, _INDEX), "token-index")


def read_files(index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32."""
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row a shard
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = index.join(bases.hint("merge"), "shard").select("file", "doc_id", "at", "n_tokens", (F.col("base") + F.col("at")).alias("start"))
    rows = rows.repartition(n_parts(index.sparkSession), "file").sortWithinPartitions("file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            files, at, n = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in range(0, len(files), 256):
                ids = []
                for j in range(i, min(i + 256, len(files))):
                    if files[j] != name:
                        name = files[j]
                        shard = ShardReader(name)
                    ids.append(shard.ids(at[j], n[j]).astype("<u4", copy=False).tobytes())
                own = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(4), own.column(3), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write docs to folder (the shared one unless given) and read them back."""
    return read_files(write_files(docs, folder or new_folder(docs.sparkSession, "tokens"), tokenizer))
