"""Best-fit packing of tokenized documents into sequences of fixed length.

The size of a piece is an integer from 1 to ``capacity``, so the whole instance is a
histogram of at most ``capacity`` counts, whatever the corpus. On it, the Martello-Toth
reduction fixes sets that dominate every alternative for their largest member; the rest is
packed best-fit, largest first, in classes of equally filled sequences. What comes out is a
table of slots (size, ranks, first sequence, offset); pieces find theirs by their rank
among pieces of the same size, which is counted in salted groups."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eralens.llm.common import blocks, stage, texts

CAPACITY = 2048
SEPARATOR = 0
CACHED_WORDS = 1_000_000      # per Python worker
ROWS_PER_GROUP = 100_000      # pieces ranked in one group


class WordTokenizer(dict):
    """Ids (packed, 32 bits) of a tokenizer whose words never cross white space, by word.

    Such a tokenizer drops white space and lowers case first, so a text's ids are those of
    its words in a row, and a word's are those of its pieces (letters, single digits, marks)
    in lower case. Texts of printable ASCII and Latin letters take that way; any other text,
    and one that may spell a special token, is encoded as a whole."""

    PLAIN = re.compile("[^\t\n\r -~¡-ſ]|<\\|")
    LETTERS = "".join(chr(c) for c in range(0xA1, 0x180) if chr(c).isalpha())
    PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9²³¹¼½¾]|[^\sa-z{LETTERS}0-9²³¹¼½¾]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.use(Tokenizer.from_file(path))

    @classmethod
    def of(cls, tokenizer) -> WordTokenizer:
        out = cls.__new__(cls)
        out.use(tokenizer)
        return out

    def use(self, tokenizer) -> None:
        from tokenizers import pre_tokenizers

        self.tokenizer = tokenizer
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, p: str) -> bytes:
        if not p.isascii():
            if max(p) > "ſ":
                return self.whole(p)
            p = self.as_bytes(p)[0][0]
        ids = [t.id for t in self.tokenizer.model.tokenize(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        if len(self.pieces) > CACHED_WORDS:
            self.pieces.clear()
        low, pieces = word.lower(), self.pieces
        if low.isalpha():                                           # letters alone are one piece
            out = pieces.get(low)
            if out is None:
                pieces[low] = out = self.piece(low)
        else:
            out = b""
            for p in self.PIECE.findall(low):
                if p not in pieces:
                    pieces[p] = self.piece(p)
                out += pieces[p]
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        return self.whole(text) if self.PLAIN.search(text) else b"".join(map(self.__getitem__, text.split()))


TOKENIZERS: dict[str, WordTokenizer] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc, piece, start, length, ids_crc32`` (and ``ids``).

    A null or empty text is the separator alone. Rows with the same id are pieces of their
    own. Only documents longer than ``capacity`` are cut."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = TOKENIZERS.get(tokenizer_path) or TOKENIZERS.setdefault(tokenizer_path, WordTokenizer(tokenizer_path))
        end, step = np.array([separator], "<u4").tobytes(), capacity * 4
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows, ids = [], []
                for k, text in enumerate(texts(part.column(1))):
                    raw = tokenizer.encode(text) + end
                    for piece, b in enumerate(range(0, len(raw), step)):
                        own = raw[b:b + step]
                        rows.append((k, piece, b // 4, len(own) // 4, zlib.crc32(own)))
                        if keep_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                k, piece, start, length, crc = zip(*rows)
                columns = [part.column(0).take(pa.array(k)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names=["doc", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@dataclass
class Kind:
    """Sequences filled alike: ``fill`` holds (size, how many of it)."""

    fill: tuple[tuple[int, int], ...]
    number: int


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Martello-Toth reduction; takes what it fixes out of ``counts``.

    For the largest size j: nothing fits beside it -> {j}. One more item fits at most, or
    the largest that fits fills the sequence -> {j, largest}. Two more fit at most: the
    largest alone if it is as large as the best pair, or a pair that no other pair beats
    member by member. A set is fixed as often as the counts allow, as taking items out
    never makes a condition false."""
    fixed: list[Kind] = []
    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            counts[j] -= 1                                          # j itself aside
            sizes = np.flatnonzero(counts[:room + 1])
            small, left, most = [], room, 0
            for s in sizes.tolist():                                # smallest items that fit together, three at most
                take = min(int(counts[s]), left // s, 3 - most)
                small += [s] * take
                most, left = most + take, left - take * s
                if most == 3 or take < counts[s]:
                    break
            counts[j] += 1
            chosen: tuple[int, ...] | None = None
            if most == 0:
                chosen = (j,)
            else:
                best = int(sizes[-1])
                if most == 1 or best == room:
                    chosen = (j, best)
                elif most == 2:
                    counts[j] -= 1
                    pair = best_pair(counts, sizes, room)
                    if best >= sum(pair):
                        chosen = (j, best)
                    elif pair[0] == best:
                        above = [s for s in sizes.tolist() if s > pair[1]]
                        two = [s for s in above for _ in range(min(2, int(counts[s])))][:2]
                        if len(two) < 2 or sum(two) > room:
                            chosen = (j, *pair)
                    counts[j] += 1
            if chosen is None:
                break
            fill = tuple((s, chosen.count(s)) for s in dict.fromkeys(chosen))
            times = min(int(counts[s]) // k for s, k in fill)
            for s, k in fill:
                counts[s] -= times * k
            fixed.append(Kind(fill, times))
    return fixed


def best_pair(counts: np.ndarray, sizes: np.ndarray, room: int) -> tuple[int, int]:
    """The two items with the largest sum within ``room``, the larger first."""
    found = (0, 0)
    for a in sizes[::-1].tolist():
        fits = sizes[: np.searchsorted(sizes, min(a, room - a), "right")]
        if len(fits) and fits[-1] == a and counts[a] < 2:
            fits = fits[:-1]
        if len(fits) and a + fits[-1] > sum(found):
            found = (a, int(fits[-1]))
    return found


def best_fit(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Best-fit, largest first: an item goes to the fullest sequence that has room. Equal
    items fill such a sequence one after another, so whole classes move at once."""
    open_: dict[int, list[Kind]] = {}                               # by room left
    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            room = min((r for r in open_ if r >= s), default=None)
            kind = open_[room].pop() if room is not None else Kind((), -(-n // (capacity // s)))
            if room is not None and not open_[room]:
                del open_[room]
            room = capacity if room is None else room
            each = room // s
            full = min(kind.number, n // each)
            n -= full * each
            rest = kind.number - full
            moved = [(each, full)]
            if n and rest:
                moved.append((n, 1))
                n, rest = 0, rest - 1
            for k, number in moved:
                if number:
                    open_.setdefault(room - k * s, []).append(Kind(kind.fill + ((s, k),), number))
            if rest and kind.fill:
                open_.setdefault(room, []).append(Kind(kind.fill, rest))
    return [k for kinds in open_.values() for k in kinds]


def slots(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (size, first rank, first sequence, pieces per sequence, offset), by size and rank."""
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        counts[s] = n
    kinds = reduce_dominated(counts, capacity)
    kinds += best_fit(counts, capacity)
    used, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for kind in kinds:
        offset = 0
        for s, k in kind.fill:
            rows.append((s, int(used[s]), sequence, k, offset))
            used[s] += kind.number * k
            offset += s * k
        sequence += kind.number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, largest: int) -> DataFrame:
    """``rank`` among the pieces of one length, from 0. Groups of one length are salted, so
    that a length which a third of all pieces share is ranked by many tasks; a table of
    counts by length and salt shifts them."""
    salts = blocks(largest, ROWS_PER_GROUP, 16)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "salt").orderBy("doc", "piece", "ids_crc32")
    return salted.withColumn("own", F.row_number().over(own)).join(shift, ["length", "salt"]).withColumn("rank", F.col("shift") + F.col("own") - 1).drop("salt", "own", "shift")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces (a stored table with ``doc, piece,
    length, ids_crc32``). Pieces of full length are a sequence each, with negative numbers.
    An empty table gives an empty result."""
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.where(F.col("length") < capacity).groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(slots(histogram, capacity))
    rest = ranked(pieces.where(F.col("length") < capacity), max(histogram.values(), default=0))

    columns = pieces.columns

    def place(batches):
        size, first, sequence, each, offset = table.value.T
        key = (size << 44) | first
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) | rank, "right") - 1
            past = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in columns] + [pa.array(sequence[at] + past // each[at]), pa.array(offset[at] + past % each[at] * length)],
                names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    full = pieces.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return rest.mapInArrow(place, schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    pieces = stage(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    return pack(pieces, capacity).withColumnRenamed("doc", "doc_id")
