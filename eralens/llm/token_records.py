"""Tokenized documents as length-delimited binary records, with an offset index.

A record is a frame around one serialized document, all numbers little-endian::

    length of the payload      8 bytes
    masked crc32 of those 8    4 bytes
    payload: bytes of an id (1: 2 or 4), length of the key (4, -1: null), key as UTF-8, ids
    masked crc32 of payload    4 bytes
    end mark 0x0A              1 byte

Masks rotate a checksum by 15 bits and add a constant, so that a checksum of data that holds
checksums is sound. Documents are dealt to files by ranges of their ids and sorted in each, so
files in the order of their names hold all documents in ascending order. Spark's text writer
writes the frames (its line end is the end mark), with Spark's commit of whole tasks: a lost
executor leaves no half file. Files hold about ``FILE_BYTES`` bytes.

The index has one row per record, read from the files: ``file, number, offset, size``, the key,
the number of ids, where they start among all ids, and their checksum. ``epoch`` puts it into a shuffled
order for readers that seek (``record_at``)."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eralens.llm.common import blocks, stage, text_bytes, texts
from eralens.llm.packing import WordTokenizer
from eralens.session import scratch

END_ID = 1
FILE_BYTES, CHUNK_BYTES = 32 << 20, 4 << 20
TASK_TEXT, SLICE_TEXT = 48 << 20, 4 << 20      # bytes of text a task sorts, and that are encoded at once
MASK = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<IB")
# fixed values: the settings of tokenizers whose words WordTokenizer encodes one by one
LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PLAIN = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(zlib.crc32(size))) + payload + TAIL.pack(masked(zlib.crc32(payload)), 10)


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """(payload, size of the frame) at an offset; damaged frames raise."""
    if len(data) < at + HEAD.size:
        raise ValueError(f"record at {at} is cut off")
    n, head = HEAD.unpack_from(data, at)
    if masked(zlib.crc32(data[at:at + 8])) != head:
        raise ValueError(f"length at {at} does not match its checksum")
    end = at + HEAD.size + n
    if len(data) < end + TAIL.size:
        raise ValueError(f"record at {at} is cut off")
    payload = data[at + HEAD.size:end]
    crc, mark = TAIL.unpack_from(data, end)
    if masked(zlib.crc32(payload)) != crc or mark != 10:
        raise ValueError(f"record at {at} does not match its checksum")
    return payload, HEAD.size + n + TAIL.size


def serialize(key: str | None, ids: np.ndarray) -> bytes:
    raw = (key or "").encode()
    return struct.pack("<Bi", ids.itemsize, -1 if key is None else len(raw)) + raw + ids.tobytes()


def deserialize(payload: memoryview) -> tuple[str | None, np.ndarray]:
    """(key, ids as unsigned 32-bit numbers)."""
    width, n = struct.unpack_from("<Bi", payload)
    at = 5 + max(n, 0)
    return None if n < 0 else bytes(payload[5:at]).decode(), np.frombuffer(payload[at:], f"<u{width}").astype("<u4")


class Encoder:
    """Ids of many texts. Where the tokenizer's words never cross white space, each distinct
    word of a slice is looked up once and the ids are gathered; any other text, and every text of
    another kind of tokenizer, is encoded as a whole."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        settings = json.loads(content)
        self.tokenizer = Tokenizer.from_buffer(content)
        by_words = settings.get("normalizer") == LOWER and settings.get("pre_tokenizer") == PIECES and all("<|" in t["content"] for t in settings.get("added_tokens", ()))
        self.words = WordTokenizer.of(self.tokenizer) if by_words else None
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def plain(self, text: str) -> bool:
        if self.words is None or "<|" in text:
            return False
        try:
            return not text.encode("latin-1").translate(None, PLAIN)
        except UnicodeEncodeError:
            return not WordTokenizer.PLAIN.search(text)

    def encode(self, given: list[str]) -> list[np.ndarray]:
        plain = [self.plain(x) for x in given]
        lists = pc.ascii_split_whitespace(pa.array([x if p else "" for x, p in zip(given, plain)], pa.large_string()))
        coded = lists.values.dictionary_encode()
        found = [self.words[w] for w in coded.dictionary.to_pylist()] if any(plain) else [b""] * len(coded.dictionary)
        ids, size = np.frombuffer(b"".join(found), "<u4").astype(self.kind), np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = coded.indices.to_numpy()
        first = (np.cumsum(size) - size)[each]
        size = size[each]
        ends = np.cumsum(size)
        flat = ids[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.r_[0, ends][lists.offsets.to_numpy()]
        return [flat[a:b] if p else np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.kind) for x, p, a, b in zip(given, plain, stops, stops[1:])]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_TEXT) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()) // most
    at = np.r_[0, np.flatnonzero(np.diff(size)) + 1, batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(at.tolist(), at[1:].tolist()) if b > a)


def write(docs: DataFrame, path: str, tokenizer: bytes, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
          file_bytes: int = FILE_BYTES, task_text: int = TASK_TEXT) -> None:
    """Write all documents to ``path`` in ascending order of ids (null first; rows that share an
    id in any order). ``tokenizer`` is the content of its file."""
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(tokenizer)
    tasks = blocks(text_bytes(docs, text_col), task_text)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = ENCODERS.get(content.value) or ENCODERS.setdefault(content.value, Encoder(content.value))
        end, held, size = np.array([end_id], encoder.kind), [], 0
        for batch in batches:
            for part in slices(batch, 1):
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(texts(part.column(1)))):
                    record = frame(serialize(key, np.concatenate((ids, end))))
                    held.append(record)
                    size += len(record)
                    if size >= min(file_bytes, CHUNK_BYTES):
                        yield chunk(held)
                        held, size = [], 0
        if held:
            yield chunk(held)

    def chunk(held):
        # the text writer ends a row with the end mark of its last record
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["chunk"])

    # rows of one id may be many: their place in the input splits them, text decides nothing
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(tasks, "doc", "row").sortWithinPartitions("doc", "row").select(F.col("doc").cast("string").alias("doc"), "text")
    chunks = dealt.mapInArrow(run, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    chunks.write.option("maxRecordsPerFile", max(1, file_bytes // CHUNK_BYTES)).option("lineSep", "\n").text(path)


ENCODERS: dict[bytes, Encoder] = {}


def records(spark: SparkSession, path: str, id_type: str = "bigint", keep_ids: bool = False) -> DataFrame:
    """All records of the files, checked: ``file, part, piece, number, offset, size, doc_id,
    n_tokens, before, ids_crc32`` (and ``ids``); ``before`` are the ids earlier in the file."""
    schema = "file string, number bigint, offset bigint, size bigint, key string, n_tokens bigint, before bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    kinds = [pa.string(), *[pa.int64()] * 3, pa.string(), *[pa.int64()] * 3, *[pa.list_(pa.int32())] * keep_ids]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                data, at, number, before, rows = memoryview(content.as_buffer()), 0, 0, 0, []
                while at < len(data):
                    payload, size = unframe(data, at)
                    key, ids = deserialize(payload)
                    rows.append((name, number, at, size, key, len(ids), before, zlib.crc32(ids), *[ids.view("<i4")] * keep_ids))
                    at, number, before = at + size, number + 1, before + len(ids)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, schema)
    place = [F.regexp_extract("file", r"part-(\d+)-[^/]*-c(\d+)[^/]*$", k).cast("bigint").alias(n) for k, n in ((1, "part"), (2, "piece"))]
    return found.select("file", *place, "number", "offset", "size", F.col("key").cast(id_type).alias("doc_id"), "n_tokens", "before", "ids_crc32", *["ids"] * keep_ids)


def index(spark: SparkSession, path: str, id_type: str = "bigint", per_block: int = 1024) -> DataFrame:
    """The stored offset index: ``file, number, offset, size, doc_id, start, n_tokens,
    ids_crc32``. Where a file's ids start comes from a sum over the files' totals, in two
    steps, as files may be many."""
    seen = stage(records(spark, path, id_type), "records-seen")
    files = seen.groupBy("file", "part", "piece").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("part") / per_block))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = files.withColumn("own", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("block").orderBy("part", "piece"))), F.lit(0)))
    whole = files.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(earlier(Window.orderBy("block"))), F.lit(0)).alias("shift"))
    at = inside.join(whole, "block").select("file", (F.col("own") + F.col("shift")).alias("at"))
    return stage(seen.join(at, "file").select("file", "number", "offset", "size", "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"), "records-index")


def epoch(found: DataFrame, seed: int, shards: int) -> DataFrame:
    """The index in a shuffled order that ``seed`` fixes: ``shard, turn, file, offset, size``. Each
    reader takes a shard, in the order of ``turn``."""
    turn = F.xxhash64(F.lit(seed), "file", "number")
    return found.select(F.pmod(turn, F.lit(shards)).cast("int").alias("shard"), turn.alias("turn"), "file", "offset", "size").repartition(shards, "shard").sortWithinPartitions("shard", "turn")


def record_at(handle, offset: int, size: int) -> tuple[str | None, np.ndarray]:
    """(key, ids) of one record, from a file that can seek."""
    handle.seek(offset)
    return deserialize(unframe(memoryview(handle.read(size)), 0)[0])


def tokenizer_bytes(path: str | None = None) -> bytes:
    """A tokenizer file's content, read on the driver; executors get it by broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def export(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the records, read them back and return the index, one row per document: ``doc_id,
    start, n_tokens, ids_crc32, file, number, offset, size``.

    Null and empty texts hold the end id alone; rows without an id come first; rows that share
    an id are records of their own; an empty table gives an empty index; other columns are
    not read."""
    spark = docs.sparkSession
    path = path or scratch(spark, "llm-records")
    write(docs, path, tokenizer_bytes(tokenizer_path), id_col, text_col, end_id)
    return index(spark, path, docs.schema[id_col].dataType.simpleString()).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "number", "offset", "size")
