"""Token sequences in training order, as binary shards of fixed stride.

The documents of a table are one stream of 16-bit token ids, each document followed by an end mark. The stream
falls into sequences of STRIDE ids, numbered 0 .. N-1; packed, a sequence goes on with the next document where
one ends, else every document starts a sequence of its own and its last one is padded. A keyed Feistel
permutation of the next power of four, walked along its cycle until it lands below N, turns the number into
a global slot: a bijection that needs no shuffle buffer, no sort key and no state. A shard is a range
of PER_SHARD slots; a task holds a range of whole shards, in slot order, without sampling the range; a record's
place is slot mod PER_SHARD times the record size, so a reader resumes at any slot by one seek.

Texts move once, as ids on their way to their slots. Numbering moves nothing: a first pass counts each
partition's ids, the partitions' starts (one number for each run of rows of one file) are broadcast, and the
second pass adds up again inside the partition. Rows are in order of file and place in the file, so the order does not
depend on how the files are split. Rows that come from no file are written to the shared folder first.

Null text is an empty document: its end mark only. Ids of any type, null ones too, are carried along. Repeated
rows follow one another like others. An empty table gives no sequences. Columns other than id and text are left out.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col

STRIDE = 2048
PER_SHARD = 1024
END, PAD = 256, 257
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ROUNDS = 6
FLUSH_BYTES = 4_000_000
#: The split pattern that the byte-level vocabularies were made with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0 .. n-1."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    x = np.asarray(x, np.uint64).copy()

    def permute(v):
        left, right = v >> np.uint64(half), v & mask
        for r in range(ROUNDS):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x2545F4914F6CDD1D + r * 0xD6E8FEB86659FD93) % (1 << 64))
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return (left << np.uint64(half)) | right

    todo = np.arange(len(x))
    while len(todo):
        x[todo] = permute(x[todo])
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def unfeistel(y: np.ndarray, n: int, key: int) -> np.ndarray:
    """The inverse of `feistel`: the sequence numbers of given slots."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    y = np.asarray(y, np.uint64).copy()

    def back(v):
        left, right = v >> np.uint64(half), v & mask
        for r in reversed(range(ROUNDS)):
            f = left * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x2545F4914F6CDD1D + r * 0xD6E8FEB86659FD93) % (1 << 64))
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right ^ (f & mask), left
        return (left << np.uint64(half)) | right

    todo = np.arange(len(y))
    while len(todo):
        y[todo] = back(y[todo])
        todo = todo[y[todo] >= n]
    return y.astype(np.int64)


class ByteEncoder:
    """UTF-8 bytes as ids; 256 ends a document and 257 pads."""

    end, pad = END, PAD

    def counts(self, ids: pa.Array, column: pa.Array) -> list[int]:
        return [len(x) for x in self.arrays(ids, column)]

    def arrays(self, ids: pa.Array, column: pa.Array):
        for text in column:
            yield np.frombuffer(text.as_buffer(), np.uint8).astype(np.uint16) if text.is_valid else np.zeros(0, np.uint16)


_ENCODINGS: dict[str, object] = {}


class RankEncoder:
    """Ids of a byte-level vocabulary file (lines of base64 token and rank); the two ids above it end a document and pad.

    Decoding returns the very text. The vocabulary is read once, on the driver, and broadcast.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str = SPLIT):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.end = max(ranks.values()) + 1
        self.pad = self.end + 1
        if self.pad > 65_535:
            raise ValueError("the vocabulary does not fit 16 bits")
        self.name, self.shared = f"{path} {pattern}", spark.sparkContext.broadcast((ranks, pattern))

    def encoding(self):
        import tiktoken

        if self.name not in _ENCODINGS:
            ranks, pattern = self.shared.value
            _ENCODINGS[self.name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return _ENCODINGS[self.name]

    def arrays(self, ids: pa.Array, column: pa.Array):
        encode = self.encoding().encode_ordinary
        for text in column:
            yield np.array(encode(text.as_py()), np.uint16) if text.is_valid else np.zeros(0, np.uint16)

    def counts(self, ids: pa.Array, column: pa.Array) -> list[int]:
        """The numbers of ids, without arrays of them."""
        encode = self.encoding().encode_ordinary
        return [len(encode(text.as_py())) if text.is_valid else 0 for text in column]


def _runs(encoder, stride: int, pack: bool):
    """Ids in each run of rows of one file within a partition: partition, run, file, first row, ids."""

    def run(batches):
        part, out = TaskContext.get().partitionId(), []
        for batch in batches:
            for file, row, ids in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), encoder.counts(batch.column(0), batch.column(1)), strict=True):
                if not out or out[-1][0] != file:
                    out.append([file, row, 0])
                out[-1][2] += _room(ids, stride, pack)
        if out:
            file, row, total = zip(*out, strict=True)
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(file, pa.string()), pa.array(row, pa.int64()), pa.array(total, pa.int64())], ["part", "run", "file", "row", "total"])

    return run


def _room(ids: int, stride: int, pack: bool) -> int:
    """Ids of the stream that a document takes, with its end mark and, unpacked, its padding."""
    return ids + 1 if pack else -(-(ids + 1) // stride) * stride


def _cut(shared, encoder, total: int, stride: int, per_shard: int, key: int, pack: bool):
    """The documents' parts by sequence: slot, at (first id), shard, doc_id, seq, n and the ids."""

    def run(batches):
        table, part = shared.value, TaskContext.get().partitionId()
        number, last = np.searchsorted(table["part"], [part, part + 1]).tolist()
        before, place, end = None, None, None
        held, size = [], 0

        def check(ok):
            if not ok:
                raise ValueError("the table is split in another way than when it was counted")

        for batch in batches:
            for i, file, row, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), encoder.arrays(batch.column(0), batch.column(1)), strict=True):
                if place is None or file != before:
                    check(place == end and number < last and table["row"][number] == row)
                    before, place = file, int(table["start"][number])
                    end = place + int(table["total"][number])
                    number += 1
                ids = np.append(ids, np.uint16(encoder.end))
                at, first = 0, place // stride
                while at < len(ids):
                    seq, offset = divmod(place + at, stride)
                    piece = ids[at : at + stride - offset]
                    held.append((seq, offset, i, seq if pack else seq - first, len(piece), piece.tobytes()))
                    at += len(piece)
                place += _room(len(ids) - 1, stride, pack)
                size += 2 * len(ids)
                if size > FLUSH_BYTES:
                    yield _parts(held, total, per_shard, key, batch.schema.field(0).type)
                    held, size = [], 0
        check(place == end and number == last)
        if held:
            yield _parts(held, total, per_shard, key, batch.schema.field(0).type)

    return run


def _parts(held, total, per_shard, key, id_type):
    number, at, doc, seq, n, ids = zip(*held, strict=True)
    slot = feistel(np.array(number), total, key)
    return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(at, pa.int32()), pa.array(slot // per_shard), pa.array(doc, id_type), pa.array(seq, pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())], ["slot", "at", "shard", "doc_id", "seq", "n", "ids"])


def _assemble(stride: int, pad: int):
    """Records of fixed size of parts in order of slot and place; a record bears the id of its first document."""

    def run(batches):
        head, ids, rows, schema = None, [], [], None

        def close():
            raw = b"".join(ids)
            rows.append((*head, len(raw) // 2, raw + np.full(stride - len(raw) // 2, pad, np.uint16).tobytes()))

        def flush():
            slot, shard, doc, seq, n, payload = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(shard, pa.int64()), pa.array(doc, schema), pa.array(seq, pa.int64()), pa.array(n, pa.int32()), pa.array(payload, pa.binary())], ["slot", "shard", "doc_id", "seq", "n_tokens", "payload"])

        for batch in batches:
            schema = batch.schema.field(3).type
            for slot, shard, doc, seq, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 6)), strict=True):
                if head is None or slot != head[0]:
                    if head is not None:
                        close()
                    head, ids = (slot, shard, doc, seq), []
                ids.append(raw)
            if len(rows) * stride * 2 > FLUSH_BYTES:
                yield flush()
                rows = []
        if head is not None:
            close()
            yield flush()

    return run


def _plain_scan(docs: DataFrame) -> bool:
    """Whether the rows come straight from Parquet files, so that they have a place there."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()
    return bool(docs.inputFiles()) and plan[-1].strip(" +-").startswith("Relation") and plan[-1].rstrip().endswith("parquet") and all(x.strip(" +-").startswith(("Project", "Filter", "Relation")) for x in plan)


def pin_splits(spark: SparkSession) -> None:
    """Hold how files are split for the session: the default follows the cores at hand, which change when executors go."""
    name = "spark.sql.files.minPartitionNum"
    if not spark.conf.get(name, None):
        spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)


def training_records(spark: SparkSession, docs: DataFrame, stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = 2024, id_col: str = "doc_id", text_col: str = "text", encoder=None, pack: bool = False) -> DataFrame:
    """slot, shard, doc_id, seq, n_tokens, payload; a partition is a range of whole shards, sorted by slot.

    Packed, doc_id is the document that a sequence starts with or in, and seq its number in the stream; else seq
    counts within the document. Give rows as read from files: others are written to the shared folder first.
    """
    encoder = encoder or ByteEncoder()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    if not _plain_scan(docs):
        docs, id_col, text_col = Scratch(spark, "order").save(rows), "doc_id", "text"
    place = docs.metadataColumn("_metadata")
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    pin_splits(spark)
    runs = rows.mapInArrow(_runs(encoder, stride, pack), "part int, run int, file string, row bigint, total bigint").toArrow()
    form = f"slot bigint, shard bigint, doc_id {kind}, seq bigint, n_tokens int, payload binary"
    runs = runs.sort_by([("file", "ascending"), ("row", "ascending")])
    sums = np.cumsum(runs["total"].to_numpy())
    starts = pd.DataFrame({"part": runs["part"], "run": runs["run"], "row": runs["row"], "start": np.r_[0, sums[:-1]][: len(sums)], "total": runs["total"]}).sort_values(["part", "run"])
    ids = int(sums[-1]) if len(sums) else 0
    total = -(-ids // stride)
    if not total:
        return spark.createDataFrame([], form)
    shared = spark.sparkContext.broadcast({c: starts[c].to_numpy(np.int64) for c in starts})
    parts = rows.mapInArrow(_cut(shared, encoder, total, stride, per_shard, key, pack), f"slot bigint, at int, shard bigint, doc_id {kind}, seq bigint, n int, ids binary")
    shards = -(-total // per_shard)
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int"))
    return dealt.sortWithinPartitions("slot", "at").mapInArrow(_assemble(stride, encoder.pad), form)


def _writer(folder: str):
    def run(batches):
        import os
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        open_shard, sink, held, last, temporary, id_type = None, None, [], -1, "", None

        def close():
            sink.close()
            store.move(temporary, f"{root}/shard-{open_shard:08d}.bin")
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), id_type, pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["slot", "shard", "doc_id", "seq", "n_tokens", "byte_offset", "bytes"])

        for batch in batches:
            id_type = batch.schema.field(2).type
            for slot, shard, doc, seq, n, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot <= last:
                    raise ValueError("records are out of order")
                last = slot
                if shard != open_shard:
                    if sink:
                        yield close()
                    open_shard, held = shard, []
                    temporary = f"{root}/_{shard:08d}-{os.getpid()}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temporary)
                held.append((slot, shard, doc, seq, n, sink.tell(), len(payload)))
                sink.write(payload)
        if sink:
            yield close()

    return run


def write_shards(records: DataFrame, folder: str) -> DataFrame:
    """Write shard-NNNNNNNN.bin files to a folder given as URI and tell where each record lies; a retried task renames over its shard."""
    kind = records.schema["doc_id"].dataType.simpleString()
    return records.mapInArrow(_writer(folder), f"slot bigint, shard bigint, doc_id {kind}, seq bigint, n_tokens int, byte_offset bigint, bytes bigint")


def _reader(folder: str):
    """Checksums of the records as they lie in the shards."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        open_shard, source = None, None
        for batch in batches:
            sums = []
            for shard, at, size in zip(*(batch.column(k).to_pylist() for k in (1, 5, 6)), strict=True):
                if shard != open_shard:
                    if source:
                        source.close()
                    open_shard, source = shard, store.open_input_file(f"{root}/shard-{shard:08d}.bin")
                raw = source.read_at(size, at)
                if len(raw) != size:
                    raise ValueError(f"shard {shard} ends early")
                sums.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sums, pa.int64())], ["slot", "shard", "doc_id", "seq", "n_tokens", "byte_offset", "crc32"])
        if source:
            source.close()

    return run


def written_records(spark: SparkSession, records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the shards, by default to the shared folder; the records without payload, read back: place in the shard and checksum."""
    box = Scratch(spark, "shards")
    folder = folder or f"{box.base}/bin"
    placed = box.save(write_shards(records, folder))
    kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(_reader(folder), f"slot bigint, shard bigint, doc_id {kind}, seq bigint, n_tokens int, byte_offset bigint, crc32 bigint")


def read_from(folder: str, slot: int, stride: int = STRIDE, per_shard: int = PER_SHARD):
    """(slot, ids) of the records from `slot` on, in training order: one seek, then sequential reads, one record in memory."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    size = 2 * stride
    while True:
        shard, at = divmod(slot, per_shard)
        path = f"{root}/shard-{shard:08d}.bin"
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound or at * size >= info.size:
            return
        with store.open_input_file(path) as source:
            source.seek(at * size)
            for _ in range(at, info.size // size):
                yield slot, np.frombuffer(source.read(size), np.uint16)
                slot += 1
