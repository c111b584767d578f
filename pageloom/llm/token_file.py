"""Token ids in fixed-width bit-packed shard files.

A shard holds its documents' ids one after another, each in as many bits as the
vocabulary needs. Layout (little-endian):

    magic  8 bytes, version u32, width u32, ids per block u32, reserved u32
    blocks each ``ids per block`` ids packed from the lowest bit up, padded to a byte
    index  block offsets u64[blocks + 1], doc ids i64[docs], null marks u8[docs],
           starts u64[docs + 1]
    end    blocks u64, docs u64, ids u64, offset of the index u64, magic

The index finds any document's blocks; unpacking a run of blocks is a few numpy
operations. Documents are dealt to shards by range of doc_id and sorted within
them. A task writes under a name of its own attempt and renames the finished file,
so a lost or repeated task leaves one whole shard. A manifest in JSON lists the
shards with the number of ids before each.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, byte_batches, default_path
from .common import release, shared_dir, table

MAGIC = b"PLTOKEN1"
BLOCK = 65_536
HEAD = struct.Struct("<8sIIII")
END = struct.Struct("<QQQQ8s")


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.held, self.n_held, self.n = [], 0, 0
        self.at, self.offsets = HEAD.size, [HEAD.size]
        self.doc_ids, self.nulls, self.sizes = [], [], []
        out.write(HEAD.pack(MAGIC, 1, width, block, 0))

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.sizes.append(sizes)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= self.block:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        for i in range(0, n, self.block):
            data = pack(ids[i : min(i + self.block, n)], self.width)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        if self.n_held:
            self._flush(self.n_held)
        sizes = np.concatenate(self.sizes) if self.sizes else np.empty(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        for x in (self.doc_ids, self.nulls):
            self.out.write(b"".join(a.tobytes() for a in x))
        self.out.write(starts.tobytes())
        self.out.write(END.pack(len(self.offsets) - 1, len(sizes), self.n, self.at, MAGIC))
        return len(sizes), self.n


class Reader:
    """Random access to a shard through any seekable file."""

    def __init__(self, f, size: int):
        self.f = f
        magic, _, self.width, self.block, _ = HEAD.unpack(self._at(0, HEAD.size))
        blocks, docs, self.n, at, again = END.unpack(self._at(size - END.size, END.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError("not a token file")
        index = self._at(at, size - END.size - at)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        p = 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(index, "<i8", docs, p)
        self.nulls = np.frombuffer(index, np.uint8, docs, p + 8 * docs).astype(bool)
        self.starts = np.frombuffer(index, "<u8", docs + 1, p + 9 * docs).astype(np.int64)

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; only their blocks are read."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = self._at(self.offsets[first], int(self.offsets[last + 1] - self.offsets[first]))
        out = []
        for b in range(first, last + 1):  # each block is padded to a byte
            n = min(self.block, self.n - b * self.block)
            at = int(self.offsets[b] - self.offsets[first])
            out.append(unpack(data[at : at + int(self.offsets[b + 1] - self.offsets[b])], n, self.width))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]


def _fs(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


def publish(fs, own: str, name: str) -> None:
    """Give an attempt's finished file its name. Where a name is not overwritten, the file
    of an earlier attempt of the task, of the same content, stays."""
    from pyarrow.fs import FileType

    try:
        fs.move(own, name)
    except OSError:
        if fs.get_file_info(name).type == FileType.NotFound:
            raise
        fs.delete_file(own)


def write_token_files(documents: DataFrame, path: str, folder: str, end_id: int = 0) -> list[dict]:
    """Encode the texts, append ``end_id`` to each and write the shards; returns the
    manifest, one entry per shard (as many as shuffle partitions), in order.

    Null texts count as empty. Rows with equal doc_id keep apart, ordered by a hash of
    their texts; a null doc_id comes first. Other columns are ignored."""
    width = width_of(Encoder.of(path).tokenizer.get_vocab_size(with_added_tokens=True))

    def write(batches):
        from pyspark import TaskContext

        task, encoder, writer, out = TaskContext.get(), Encoder.of(path), None, None
        fs, base = _fs(folder)
        shard = task.partitionId()
        name, own = f"{base}/shard-{shard:06d}.tok", f"{base}/_attempt-{shard}-{task.taskAttemptId()}"
        for big in batches:
            for b in byte_batches(big, "text"):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(own)
                    writer = Writer(out, width)
                n, ids = encoder.encode(b.column("text"))
                ends = np.cumsum(n)
                writer.add(b.column("doc_id"), n + 1, np.insert(ids, ends, end_id))
        if writer is not None:
            docs, total = writer.close()
            out.close()
            publish(fs, own, name)
            release()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [docs], "n_ids": [total]}, pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    docs = documents.select(F.col("doc_id").cast("long"), "text").withColumn("_tie", F.xxhash64("text"))
    dealt = docs.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    shards = sorted(dealt.mapInArrow(write, "shard long, n_docs long, n_ids long").collect())
    manifest, before = [], 0
    for s in shards:
        manifest.append({"file": f"shard-{s.shard:06d}.tok", "n_docs": s.n_docs, "n_ids": s.n_ids, "before": before})
        before += s.n_ids
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"version": 1, "width": width, "end_id": end_id, "shards": manifest}).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str, docs_per_task: int = 20_000, run_ids: int = 1 << 22) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 of its ids as little-endian 32-bit integers."""
    fs, base = _fs(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    parts = [(s["file"], s["before"], at, min(at + docs_per_task, s["n_docs"])) for s in shards for at in range(0, s["n_docs"], docs_per_task)]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        fs, base = _fs(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                file, before, first, last = parts[k]
                with fs.open_input_file(f"{base}/{file}") as f:
                    r = Reader(f, f.size())
                    at = first
                    while at < last:
                        to = max(at + 1, min(last, int(np.searchsorted(r.starts, r.starts[at] + run_ids, "right")) - 1))
                        ids, off = r.ids(r.starts[at], r.starts[to]), r.starts[at]
                        crc = [zlib.crc32(ids[r.starts[i] - off : r.starts[i + 1] - off].tobytes()) for i in range(at, to)]
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[at:to], pa.int64(), mask=r.nulls[at:to]), pa.array(before + r.starts[at:to], pa.int64()), pa.array(np.diff(r.starts[at : to + 1]), pa.int64()), pa.array(crc, pa.int64())], schema=schema)
                        at = to

    n = max(1, len(parts))
    return spark.range(0, len(parts), 1, n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(documents: DataFrame, path: str) -> DataFrame:
    folder = shared_dir(documents.sparkSession, "tokens")
    write_token_files(documents, path, folder)
    return read_token_files(documents.sparkSession, folder)


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_files(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
