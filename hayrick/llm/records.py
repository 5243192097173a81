"""Token ids in length-delimited binary records with a separate offset index.

A record is framed as

    length of the payload   uint64, little-endian
    masked checksum of those eight bytes   uint32
    payload
    masked checksum of the payload   uint32

and the payload is a flag byte (1: the document id is null), the document id (int64), the width of an id in bytes
(2 or 4) and the ids. The checksum is CRC-32 (the polynomial of zlib, which Python computes natively), rotated and
shifted by the usual mask. Beside each ``.rec`` file stands its ``.idx``: for every record the uint64 offset of its frame
and the uint64 number of tokens before it in the file, then a last pair with the file's length and tokens, so that any
record or range of records can be read alone.

Each attempt of a task writes files of its own name, and the manifest, which Spark commits, names those of the attempts
that counted. A killed or repeated attempt can therefore leave a file behind, but never one that a reader opens;
``remove_orphans`` deletes such files. Files are opened by the Arrow file systems: ``file``, ``hdfs``, ``gs``, ``s3`` (also
spelled ``s3a`` or ``s3n``) and ``abfs``.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hayrick.llm.pieces import PieceCache, batches, encode_around
from hayrick.session import fresh_path

# The mask of framed checksums.
_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<BqB")
_PLACE = struct.Struct("<QQ")
#: Pieces that a worker's cache holds.
CACHED = 1_200_000
#: Bytes of records that one reading task takes from a file at a time, and files that a task keeps open.
RANGE, OPEN = 32 << 20, 16
MANIFEST = "part int, file string, records bigint, tokens bigint, bytes bigint"


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_checksum(size)), payload, struct.pack("<I", masked_checksum(payload))))


def unframe(read) -> bytes | None:
    """The next payload of ``read(n)``, or None at the end; a damaged or cut record raises ValueError."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_checksum(head[:8]):
        raise ValueError("record length is damaged")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked_checksum(body[:size]):
        raise ValueError("record payload is damaged")
    return body[:size]


def pack_ids(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}", copy=False).tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    if len(payload) < _HEAD.size:
        raise ValueError("record payload is damaged")
    null, doc_id, width = _HEAD.unpack_from(payload)
    return (None if null else doc_id), np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


@lru_cache(4)
def _cache(path: str, specials: str) -> tuple[PieceCache, dict[str, int]]:
    """A worker's piece cache over the tokenizers library, and the strings that stand for an id of their own.

    Unseen pieces go to the library in one batch.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    strings = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()} if specials == "ids" else {}
    tokenizer.encode_special_tokens = True  # pieces hold no special token's string that is to be one

    def encode_new(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts

    return PieceCache(encode_new, CACHED), strings


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def write_records(docs: DataFrame, tokenizer_file: str, end_id: int, uri: str | None = None, width: int = 2, id_col: str = "doc_id", text_col: str = "text", specials: str = "text") -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes all records in ascending document order.

    Runs the job and returns the manifest (one row per file, in document order): part, file, records, tokens, bytes.
    ``width`` is the number of bytes of an id: 2 for vocabularies of up to 65,536 ids, else 4. The strings of the file's
    added tokens (``<|endoftext|>``) inside a text are ordinary text, as the tokenizer files' own README has them; with
    ``specials="ids"`` each becomes its one id, as the library reads them when it is left as loaded.

    Defined cases: null or empty text gives a record that holds only ``end_id``; null document ids come first;
    rows with the same id follow each other, ordered by their text; other columns are ignored; an empty table
    gives an empty manifest.
    """
    spark = docs.sparkSession
    uri = uri or fresh_path(spark, "records")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, strings = _cache(tokenizer_file, specials)
        fs, root = _open(uri)
        part = TaskContext.get().partitionId()
        file = f"part-{part:05d}-{uuid.uuid4().hex}"
        out, index, at, tokens, records = None, None, 0, 0, 0
        end = np.array([end_id], np.uint32)
        for batch in it:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if out is None and texts:
                fs.create_dir(root, recursive=True)
                out, index = (fs.open_output_stream(f"{root}/{file}.{kind}", buffer_size=1 << 20) for kind in ("rec", "idx"))
            for a, b in batches(texts):
                ids, counts = encode_around(texts[a:b], cache, strings)
                if width == 2 and max(end_id, int(ids.max(initial=0))) > 0xFFFF:
                    raise ValueError("an id needs more than two bytes: use width=4")
                stop = np.cumsum(counts)
                for doc_id, low, high in zip(ids_of[a:b], (stop - counts).tolist(), stop.tolist(), strict=True):
                    record = frame(pack_ids(doc_id, np.concatenate([ids[low:high], end]), width))
                    index.write(_place(at, tokens))
                    at += len(record)
                    tokens += high - low + 1
                    records += 1
                    out.write(record)
        if out is None:
            return
        index.write(_place(at, tokens))
        out.close()
        index.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "file": file, "records": records, "tokens": tokens, "bytes": at}], schema=_MANIFEST_ARROW)

    path = f"{uri}/manifest"
    ordered.mapInArrow(run, MANIFEST).withColumn("uri", F.lit(uri)).write.parquet(path)
    return spark.read.schema(f"{MANIFEST}, uri string").parquet(path)


_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
_READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_le32", pa.binary())])
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_le32 binary"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ_ARROW.types, strict=True)], schema=_READ_ARROW)


def _files(manifest: DataFrame) -> DataFrame:
    """The manifest (one short row per file) with the number of tokens before each file."""
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.where("records > 0").withColumn("before", F.coalesce(before, F.lit(0)))


class _Files:
    """Open record files and their indexes, the most recently used ones."""

    def __init__(self):
        self.open: OrderedDict[tuple[str, str], tuple] = OrderedDict()

    def get(self, uri: str, file: str) -> tuple:
        key = (uri, file)
        if key not in self.open:
            fs, root = _open(uri)
            self.open[key] = tuple(fs.open_input_file(f"{root}/{file}.{kind}") for kind in ("rec", "idx"))
            while len(self.open) > OPEN:
                self._close(self.open.popitem(last=False)[1])
        self.open.move_to_end(key)
        return self.open[key]

    def _close(self, files: tuple) -> None:
        for f in files:
            f.close()

    def close(self) -> None:
        for files in self.open.values():
            self._close(files)


def _place(at: int, tokens: int) -> bytes:
    return _PLACE.pack(at, tokens)


def _places(index, first: int, count: int) -> np.ndarray:
    """(offset, tokens before) of ``count`` records from ``first`` on, and of what follows them."""
    size = _PLACE.size
    raw = index.read_at((count + 1) * size, first * size)
    if len(raw) < (count + 1) * size:
        raise ValueError("the offset index is cut")
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def read_records(manifest: DataFrame) -> DataFrame:
    """All records: doc_id, start (tokens before it in the whole set), n_tokens, ids_le32 (the ids as little-endian
    unsigned 32-bit integers).

    Files are cut into ranges of records of about RANGE bytes, which tasks read through the offset index, one record in
    memory at a time. Checksums are verified, and so is that the frames and tokens lie where the index says; a damaged
    record, a damaged, cut or missing index, or a missing file fails. An empty manifest gives an empty result.
    """
    steps = F.ceil(F.col("bytes") / RANGE)
    each = F.greatest(F.lit(1), F.ceil(F.col("records") / steps)).cast("bigint")
    ranges = _files(manifest).withColumn("each", each).withColumn("first", F.explode(F.expr("sequence(0L, records - 1, each)")))
    ranges = ranges.select("uri", "file", "before", "first", F.least("each", F.col("records") - F.col("first")).alias("count"))
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    dealt = ranges.repartition(max(1, -(-total // RANGE)), "file", "first")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for batch in it:
            for row in batch.to_pylist():
                data, index = files.get(row["uri"], row["file"])
                places = _places(index, row["first"], row["count"])
                data.seek(int(places[0, 0]))
                rows, size = [], 0
                for (at, before), (end, after) in zip(places[:-1].tolist(), places[1:].tolist()):
                    payload = unframe(data.read)
                    if payload is None:
                        raise ValueError("the file ends before its index does")
                    doc_id, ids = unpack_ids(payload)
                    if data.tell() != end or len(ids) != after - before:
                        raise ValueError(f"the offset index does not fit the record at {at}")
                    rows.append((doc_id, row["before"] + before, len(ids), ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size > 4 << 20:
                        yield _emit(rows)
                        rows, size = [], 0
                if rows:
                    yield _emit(rows)
        files.close()

    return dealt.mapInArrow(run, READ)


def read_shuffled(manifest: DataFrame, seed: int = 0, partitions: int = 64) -> DataFrame:
    """All records in a random order that depends on the seed alone, read through the offset index.

    Each partition gets a random share of record numbers and reads their two index entries and frames; at most OPEN
    files are open at a time. Columns are those of ``read_records``.
    """
    numbers = _files(manifest).select("uri", "part", "file", "before", F.explode(F.expr("sequence(0L, records - 1)")).alias("number"))
    order = F.xxhash64("part", "number", F.lit(seed))
    dealt = numbers.withColumn("place", order).repartition(partitions, "place").sortWithinPartitions("place", "part", "number").select("uri", "file", "before", "number")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for batch in it:
            rows, size = [], 0
            for row in batch.to_pylist():
                data, index = files.get(row["uri"], row["file"])
                (at, before), (end, after) = _places(index, row["number"], 1).tolist()
                data.seek(at)
                doc_id, ids = unpack_ids(unframe(data.read) or b"")
                if data.tell() != end or len(ids) != after - before:
                    raise ValueError(f"the offset index does not fit the record at {at}")
                rows.append((doc_id, row["before"] + before, len(ids), ids.astype("<u4").tobytes()))
                size += 4 * len(ids)
                if size > 4 << 20:
                    yield _emit(rows)
                    rows, size = [], 0
            if rows:
                yield _emit(rows)
        files.close()

    return dealt.mapInArrow(run, READ)


def remove_orphans(manifest: DataFrame) -> int:
    """Deletes record files beside the manifest that it does not name; returns their number. Run it when no writer runs."""
    gone = 0
    for (uri,) in manifest.select("uri").distinct().collect():  # one folder for each set of records
        named = {f"{r['file']}.{kind}" for r in manifest.where(F.col("uri") == uri).select("file").toLocalIterator() for kind in ("rec", "idx")}
        fs, root = _open(uri)
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.endswith((".rec", ".idx")) and info.base_name not in named:
                fs.delete_file(info.path)
                gone += 1
    return gone
