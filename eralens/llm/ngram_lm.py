"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs over the training texts are quantised on a logarithmic
scale. A filter of bits holds an n-gram of level q under q keys, (n-gram, 1) to (n-gram, q);
a probe asks for growing levels until one is missing, and so errs upwards only, and rarely
by more than a level. Workers hold the filter whole; its size is a parameter (``FILTER_MB``),
not a function of the corpus: every pair is counted exactly, and the filter takes all pairs
from the smallest count on that fits it at the intended error rate. Words come first. What
does not fit is looked up in the exact counts (``looked_up``), so a score does not
depend on the filter's size but for its errors. Pairs seen once are no part of the model.

Probability: absolute discounting over pairs, backing off to add-one smoothed words. The
mass that a context leaves comes from exact sums over classes of contexts (hashed to
``CLASSES``), so that probabilities add up to at most one.

Word counts for the base score are exact: the ``FREQUENT`` most frequent words are
broadcast, those of other words are looked up.

What is looked up is no row by itself: the texts that a task reads in a row, some ``CHUNK``
tokens, are a chunk, which asks each hash bucket of the counts once for all n-grams that it
needs, packed, and gets their counts in the same order. What it needs of its texts until then is
packed, too. Where the filter has no room, most n-grams are asked for, so the texts are scored
in ``WAVES`` shares by hash, one after the other, and disk holds what one of them asks."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eralens.llm.common import ASCII_LOWER, arrow_rows, blocks, byte_texts, release, stage, text_bytes
from eralens.llm.minhash import KNOWN_WORDS, mix

FILTER_MB = 48
ERROR_BITS = 10                  # bits for each key held; about one false level in a hundred probes
PROBES = 5                       # bits set by a key
LEVEL_BASE = 1.7                 # level q stands for counts from LEVEL_BASE ** (q - 1)
LEVELS = 64
DISCOUNT = 0.6
MIN_PAIR = 2
FREQUENT = 1 << 17
CLASS_BITS = 16
CLASSES = 1 << CLASS_BITS
SECTIONS = 512                   # parts of the filter, each built by one group
BUCKET_BYTES = 8 << 20
WAVES = 4                        # shares of the texts that are scored one after the other if the filter lacks room
HELD, CHUNK = 1_500_000, 250_000  # tokens that a task counts before it passes counts on, and of a chunk
TEXT_ROWS, BUCKET_ROWS = 512, 2  # texts, and packed counts (megabytes each), that a worker gets at once
U = np.uint64
END = 0x5E7D0F00D5E7D0F1         # the word that ends a text
PLACES = 64                      # places in a word with random numbers of their own
DRAWN = np.random.default_rng(11).integers(0, 1 << 64, PLACES << 8, dtype=np.uint64)
PIECE_BYTES, PART_BYTES = 1 << 18, 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PAIR_MASK = U((1 << (64 - CLASS_BITS)) - 1)


def classes(words: np.ndarray) -> np.ndarray:
    return mix(words + U(0x51ED27)) >> U(64 - CLASS_BITS)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The context's class in the upper bits, a hash of the pair below."""
    return (classes(before) << U(64 - CLASS_BITS)) | (mix(before * U(0x9E3779B97F4A7C15) + words) & PAIR_MASK)


def level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(LEVEL_BASE) + 1e-9)).astype(np.int64)


LOW = np.ceil(LEVEL_BASE ** np.arange(-1.0, LEVELS) - 1e-9)      # least count of a level
LOW[0] = 0.0
HIGH = np.append(LOW[1:] - 1, LOW[-1])                           # largest count of a level


def words_of(text: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each of the words between ASCII white space, and where they start and stop in
    a text of which this begins at ``at``. Equal words have equal numbers: the sum of a random
    number for each byte and place. So words are found and told apart in one go."""
    letters = np.frombuffer(text, np.uint8)
    inside = ~SPACE[letters]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, stop
    letters, size = letters[inside], stop - start
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    each = DRAWN[((place & (PLACES - 1)) << 8) + letters]
    if size.max() > PLACES:                  # places beyond the drawn ones: those again, mixed with how often
        far = np.flatnonzero(place >= PLACES)
        each[far] = mix(each[far] + (place[far] // PLACES).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return np.add.reduceat(each, first) + size.astype(np.uint64), start + at, stop + at


class Known:
    """Hashes of the words met so far by their numbers, both in the numbers' order."""

    def __init__(self):
        self.numbers = self.hashes = np.zeros(0, np.uint64)

    def hashes_of(self, numbers: np.ndarray, text: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of distinct words, in the order of their numbers, and where they stand in the text."""
        at = np.searchsorted(self.numbers, numbers)
        new = np.flatnonzero((at == len(self.numbers)) | (np.append(self.numbers, U(0))[at] != numbers))
        out = np.append(self.hashes, U(0))[at]
        out[new] = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(start[new].tolist(), stop[new].tolist())), np.uint64, len(new))
        if len(self.numbers) + len(new) > KNOWN_WORDS:
            self.numbers, self.hashes = numbers, out
        else:
            self.numbers, self.hashes = np.insert(self.numbers, at[new], numbers[new]), np.insert(self.hashes, at[new], out[new])
        return out


def token_hashes(found: list[bytes], known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts in a row, and how many each text has: its words and an end."""
    text, at, each = b"\n".join(found).translate(ASCII_LOWER), 0, [words_of(b"", 0)]
    while at < len(text):                    # pieces that fit a processor's cache, cut at white space
        cut = GAP.search(text, at + PIECE_BYTES)
        end = cut.end() if cut else len(text)
        each.append(words_of(text[at:end], at))
        at = end
    number, start, stop = (np.concatenate(x) for x in zip(*each))
    numbers, one, where = np.unique(number, return_index=True, return_inverse=True)
    h = known.hashes_of(numbers, text, start[one], stop[one])[where]
    upto = np.searchsorted(start, np.cumsum([len(t) + 1 for t in found], dtype=np.int64))
    return np.insert(h, upto, U(END)), np.diff(upto, prepend=0) + 1


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows in a row whose texts have ``PART_BYTES`` at most, or one row of more."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def with_start(h: np.ndarray) -> np.ndarray:
    """What stands before each token; a text starts after an end, the first and all others."""
    return np.concatenate((np.array([END], np.uint64), h[:-1]))


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def packed(buckets: int, kind: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    bucket = (keys % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return [(kind, int(bucket[a]), keys[a:b].tobytes(), *narrow(counts[a:b])) for a, b in zip(at, np.append(at[1:], len(bucket)))]


def narrow(counts: np.ndarray) -> tuple[bytes, bool]:
    """Counts as bytes, and whether they are wide ones."""
    wide = bool(counts.max(initial=0) >= 1 << 16)
    return counts.astype(np.int64 if wide else np.uint16).tobytes(), wide


COUNTS = "kind int, bucket int, keys binary, counts binary, wide boolean"
COUNT_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]


def count_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, COUNT_TYPES)], names=["kind", "bucket", "keys", "counts", "wide"])


def read_counts(table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("keys")]
    counts = [np.frombuffer(c.as_buffer(), np.int64 if w.as_py() else np.uint16).astype(np.int64) for c, w in zip(table.column("counts"), table.column("wide"))]
    return np.concatenate(keys), np.concatenate(counts)


def count_ngrams(texts: DataFrame, buckets: int) -> DataFrame:
    """Exact counts: rows of packed keys, sorted, and counts by kind (1 words, 2 pairs) and hash
    bucket. Tasks add up their own first, so a frequent n-gram is one entry for each. All pairs are
    counted; those below ``MIN_PAIR``, which nothing reads, are not written."""

    def partial(batches):
        known, held, n = Known(), [[], []], 0

        def flush():
            rows = []
            for kind in (1, 2):
                rows += packed(buckets, kind, *summed(np.concatenate(held[kind - 1])))
                held[kind - 1].clear()
            return count_batch(rows)

        for batch in batches:
            for part in parts(batch, 0):
                h, _ = token_hashes(list(byte_texts(part.column(0))), known)
                held[0].append(h), held[1].append(pair_keys(with_start(h), h))
                n += len(h)
                if n > HELD:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, counts = summed(*read_counts(table))
        if kind == 2:
            keys, counts = keys[counts >= MIN_PAIR], counts[counts >= MIN_PAIR]
        return pa.Table.from_batches([count_batch([(kind, bucket, keys.tobytes(), *narrow(counts))] if len(keys) else [])])

    return texts.mapInArrow(partial, COUNTS).groupBy("kind", "bucket").applyInArrow(total, COUNTS)


def unpacked(counts: DataFrame) -> DataFrame:
    """``h, c`` rows of packed counts."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                keys, n = read_counts(batch.slice(row, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "c"])

    return counts.select("keys", "counts", "wide").mapInArrow(run, "h bigint, c bigint")


def level_sizes(counts: DataFrame) -> dict[tuple[int, int], int]:
    """How many n-grams of each kind have each exact count up to 999, then each level above
    (as 1000 + level). A bounded table."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                _, n = read_counts(one)
                at, size = np.unique(np.where(n < 1000, n, 1000 + level(n)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one.column("kind")[0].as_py()] * len(at), pa.int32()), pa.array(at), pa.array(size)], names=["kind", "at", "n"])

    rows = counts.mapInArrow(run, "kind int, at bigint, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
    return {(r["kind"], r["at"]): r["n"] for r in rows}


def choose(sizes: dict[tuple[int, int], int], filter_bits: int) -> tuple[int, int, int]:
    """(least word count, least pair count, bits): what is held, and how large the filter is."""
    height = lambda at: int(level(np.array([at]))[0]) if at < 1000 else at - 1000
    keys = lambda kind, least: sum(n * height(at) for (k, at), n in sizes.items() if k == kind and at >= least)
    room = filter_bits // ERROR_BITS
    word = next((m for m in range(1, 1000) if keys(1, m) <= room // 2), 1000)
    used = keys(1, word)
    pair = next((m for m in range(MIN_PAIR, 1000) if keys(2, m) <= room - used), 1000)
    wanted = max(1 << 16, (used + keys(2, pair)) * ERROR_BITS)
    return word, pair, min(filter_bits, -(-wanted // (SECTIONS * 64)) * SECTIONS * 64)


def frequent_from(sizes: dict[tuple[int, int], int]) -> int:
    """The least count from which on there are FREQUENT words at most."""
    least, words = 1 << 62, 0
    for at, n in sorted(((at, n) for (kind, at), n in sizes.items() if kind == 1), reverse=True):
        words += n
        if words > FREQUENT:
            break
        least = at if at < 1000 else int(LOW[at - 1000])
    return least


def sections(keys: np.ndarray) -> np.ndarray:
    """The filter's section of each n-gram, the same at all levels."""
    return (mix(keys) >> U(64 - SECTIONS.bit_length() + 1)).astype(np.int64)


def steps(keys: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the bits of each key at level q begin, and how far apart they are."""
    a = mix(keys * U(0xC2B2AE3D27D4EB4F) + np.array([q + 1], np.uint64) * U(0x165667B19E3779F9))
    return a, mix(a) | U(1)


def spots(keys: np.ndarray, q: int, section_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Section of each key (by n-gram alone) and its bits there at level q, one column each."""
    a, b = steps(keys, q)
    return sections(keys), np.stack([((a + U(k) * b) % U(section_bits)).astype(np.int64) for k in range(PROBES)], axis=1)


def build(counts: DataFrame, word: int, pair: int, bits: int) -> np.ndarray:
    """The filter as bytes. Its sections are built apart, from a hash share of the n-grams
    each; what comes to the driver is the filter, of bounded size."""
    section_bits = bits // SECTIONS

    def spread(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                kind = one.column("kind")[0].as_py()
                keys, n = read_counts(one)
                held = n >= (word if kind == 1 else pair)
                keys, q = keys[held], level(n[held]).astype(np.int16)
                if kind == 2:
                    keys = mix(keys + U(0x2B))
                if not len(keys):
                    continue
                section = sections(keys).astype(np.int32)
                order = np.argsort(section, kind="stable")
                section, keys, q = section[order], keys[order], q[order]
                at = np.flatnonzero(np.concatenate(([True], section[1:] != section[:-1])))
                parts = list(zip(at, np.append(at[1:], len(section))))
                yield pa.RecordBatch.from_arrays([pa.array(section[at]), pa.array([keys[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([q[a:b].tobytes() for a, b in parts], pa.binary())], names=["section", "keys", "levels"])

    def fill(table: pa.Table) -> pa.Table:
        out = np.zeros(section_bits, bool)
        # all of the section at once: one bucket's share of it is a few keys
        keys = np.concatenate([np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("keys")])
        top = np.concatenate([np.frombuffer(v.as_buffer(), np.int16) for v in table.column("levels")])
        for q in range(1, int(top.max(initial=0)) + 1):
            held = top >= q
            keys, top = keys[held], top[held]
            out[spots(keys, q, section_bits)[1].ravel()] = True
        return pa.table({"section": pa.array([table.column("section")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    rows = counts.mapInArrow(spread, "section int, keys binary, levels binary").groupBy("section").applyInArrow(fill, "section int, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = r["section"] * (section_bits // 8)
        out[at:at + section_bits // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def probe(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of n-grams: probed one level after the other until one is missing, and a level one
    bit after the other."""
    section_bits = len(filter_) * 8 // SECTIONS
    out, alive, q = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    first = sections(keys) * section_bits
    while len(alive) and q <= LEVELS:
        a, b = steps(keys, q)
        for k in range(PROBES):
            bit = first + (a % U(section_bits)).astype(np.int64)
            held = np.flatnonzero((filter_[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            keys, first, alive, b = keys[held], first[held], alive[held], b[held]
            a = a[held] + b
        out[alive] = q
        q += 1
    return out


class Levels:
    """Levels of the words met so far, both in the order of their hashes."""

    def __init__(self, filter_: np.ndarray):
        self.filter, self.words, self.levels = filter_, np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def of(self, words: np.ndarray) -> np.ndarray:
        """Of distinct words, in the order of their hashes."""
        at = np.searchsorted(self.words, words)
        new = np.flatnonzero((at == len(self.words)) | (np.append(self.words, U(0))[at] != words))
        out = np.append(self.levels, np.uint8(0))[at]
        out[new] = probe(self.filter, words[new])
        if len(self.words) + len(new) > KNOWN_WORDS:
            self.words, self.levels = words, out
        else:
            self.words, self.levels = np.insert(self.words, at[new], words[new]), np.insert(self.levels, at[new], out[new])
        return out


def left_over(counts: DataFrame, pair: int = MIN_PAIR) -> np.ndarray:
    """What share of a context class its pairs leave to backing off."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                keys, n = read_counts(one)
                if one.column("kind")[0].as_py() == 1:
                    at, mass, own = classes(keys).astype(np.int64), np.zeros(len(keys)), n.astype(float)
                else:
                    held = n >= pair
                    at, mass = (keys[held] >> U(64 - CLASS_BITS)).astype(np.int64), LOW[level(n[held])] - DISCOUNT
                    own = np.zeros(len(at))
                mass, own = np.bincount(at, mass, CLASSES), np.bincount(at, own, CLASSES)
                hit = np.flatnonzero((mass > 0) | (own > 0))
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(mass[hit]), pa.array(own[hit])], names=["class", "mass", "own"])

    rows = counts.mapInArrow(run, "class bigint, mass double, own double").groupBy("class").agg(F.sum("mass").alias("mass"), F.sum("own").alias("own")).collect()
    out = np.ones(CLASSES)
    for r in rows:
        if r["own"]:
            out[r["class"]] = min(1.0, max(1e-3, 1 - r["mass"] / r["own"]))
    return out


def outside(counts: DataFrame, word: int, pair: int, often: int) -> DataFrame:
    """Packed counts of the n-grams that can be asked for: words and pairs that the filter does
    not hold, and words that are not broadcast."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                kind, bucket = one.column("kind")[0].as_py(), one.column("bucket")[0].as_py()
                keys, n = read_counts(one)
                rest = n < (max(word, often) if kind == 1 else pair)
                if rest.any():
                    yield count_batch([(kind, bucket, keys[rest].tobytes(), *narrow(n[rest]))])

    return counts.mapInArrow(run, COUNTS)


def modelled(found: np.ndarray, low: np.ndarray, context: np.ndarray, share: np.ndarray, floor: int) -> np.ndarray:
    """Logarithms of the probabilities of words: counts of the pair and of the word, which err
    downwards, and of the word before, which errs upwards, and what that leaves to backing off."""
    single = (low + 1) / floor
    seen = np.where(context > 0, np.minimum(np.maximum(found - DISCOUNT, 0) / np.maximum(context, 1), 1 - 1e-3), 0.0)
    return np.log10(np.where(context > 0, seen + share * single, single))


class Chunk:
    """What the texts of a chunk need of the counts: distinct words of a text that are not broadcast
    (rare), and distinct pairs of a text that the filter leaves open, by themselves or for their words."""

    def __init__(self, first: int):
        self.first, self.size, self.tokens, self.rare, self.open = first, 0, 0, [], []

    def packed(self, buckets: int) -> tuple[list[int], list[int], pa.Array]:
        """``kind, bucket, keys``: what is asked for, by kind and bucket, and under the numbers of
        ``STATE`` what gives the scores of the texts when that is known."""
        rare_doc, rare, rare_times = (np.concatenate(x) for x in zip(*self.rare))
        doc, pair, times, *each = (np.concatenate(x) for x in zip(*self.open)) if self.open else (np.zeros(0, t) for t in OPEN)
        self.rare, self.open = [], []
        pair, one, where = np.unique(pair, return_index=True, return_inverse=True)
        word, before, no_pair, no_word, no_before, *levels = (x[one] for x in each)
        order = np.lexsort((pair % U(buckets), ~no_pair))                # those asked for, as they are asked for, then others
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        words = np.unique(np.concatenate((rare, word[no_word], before[no_before])))
        words = words[np.argsort(words % U(buckets), kind="stable")]
        by_hash = np.argsort(words).astype(np.uint32)

        def number(w, is_asked):
            out = np.zeros(len(w), np.uint32)
            out[is_asked] = by_hash[np.searchsorted(words, w[is_asked], sorter=by_hash)] + 1
            return out

        state = dict(rare_size=np.bincount(rare_doc, minlength=self.size), rare_word=number(rare, np.ones(len(rare), bool)), rare_times=rare_times, size=np.bincount(doc, minlength=self.size), pair=place[where], times=times,
                     word=number(word, no_word)[order], before=number(before, no_before)[order], found=levels[0][order], low=levels[1][order], context=levels[2][order], share=(pair >> U(64 - CLASS_BITS))[order])
        asked = [asks(buckets, kind, keys) for kind, keys in ((1, words), (2, pair[order[:np.count_nonzero(no_pair)]]))]
        kind, bucket, keys = zip(([-k for k in range(1, len(STATE) + 1)], [0] * len(STATE), pa.array([state[n].astype(t).tobytes() for n, t in STATE.items()], pa.binary())), *asked)
        return sum(kind, []), sum(bucket, []), pa.concat_arrays(keys)


#: Of an open pair of a text: which text, pair, how often, its words, whether pair, word and word before are open, levels of these.
OPEN = [np.uint32, np.uint64, np.uint32, np.uint64, np.uint64, bool, bool, bool, np.uint8, np.uint8, np.uint8]
#: Of a chunk: how many entries each text has, rare words and open pairs, and for each entry the number of the word or pair and how
#: often it occurs; for each pair the numbers of its word and of the word before, if they are asked for, levels, and the context's class.
STATE = dict(rare_size=np.uint32, rare_word=np.uint32, rare_times=np.uint32, size=np.uint32, pair=np.uint32, times=np.uint32, word=np.uint32, before=np.uint32, found=np.uint8, low=np.uint8,
             context=np.uint8, share=np.uint16)


def cells(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values of so many bytes each, which lie one after the other in the data."""
    upto = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(data))])


def values(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All numbers of binary values."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column)])


def asks(buckets: int, kind: int, keys: np.ndarray) -> tuple[list[int], list[int], pa.Array]:
    """Kinds, buckets, and the keys of each: keys come in the order of their buckets."""
    bucket = keys % U(buckets)
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return [kind] * len(at), bucket[at].tolist(), cells(np.diff(np.append(at, len(keys))) * 8, keys)


def score_texts(docs: DataFrame, shared, buckets: int) -> DataFrame:
    """Rows of chunks: documents (kind null) with their scores so far, and those of ``Chunk.packed``."""
    chunk_tokens = CHUNK
    types = dict(chunk=pa.int64(), kind=pa.int32(), bucket=pa.int32(), keys=pa.binary(), doc=to_arrow_type(docs.schema["doc"].dataType), at=pa.int64(), n_tokens=pa.int64(), known=pa.int64(), base=pa.float64(), score=pa.float64())

    def record(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types))

    def run(batches):
        m = shared.value
        filter_, freq_keys, freq_counts, share, n_train, vocabulary = m["filter"], m["keys"], m["counts"], m["share"], m["n"], m["v"]
        words_met, levels, floor, chunk = Known(), Levels(filter_), n_train + vocabulary + 1, None
        base_of = np.log10(freq_counts + 1.0)
        word_open, pair_open = m["word"] > 1, m["pair"] > MIN_PAIR

        def ended(chunk):
            kind, bucket, keys = chunk.packed(buckets)
            return record(len(kind), chunk=pa.array([chunk.first] * len(kind), pa.int64()), kind=pa.array(kind, pa.int32()), bucket=pa.array(bucket, pa.int32()), keys=keys)

        for batch in batches:
            for part in parts(batch, 2):
                h, sizes = token_hashes(list(byte_texts(part.column(2))), words_met)
                one, doc, before = len(sizes), np.repeat(np.arange(len(sizes)), sizes), with_start(h)
                # the model
                words, where = np.unique(h, return_inverse=True)
                q = levels.of(words)
                prior = np.concatenate(([np.searchsorted(words, U(END))], where[:-1]))
                pairs = pair_keys(before, h)
                distinct, pair_at = np.unique(pairs, return_inverse=True)
                q_pair, q_word, q_before = probe(filter_, mix(distinct + U(0x2B)))[pair_at], q[where], q[prior]
                context = HIGH[q_before]
                model = modelled(LOW[q_pair], LOW[q_word], context, share[classes(words).astype(np.int64)][prior], floor)
                score = np.bincount(doc, model, one)
                # the base: frequent words here, others are looked up
                at = np.minimum(np.searchsorted(freq_keys, words), max(0, len(freq_keys) - 1))
                hit = freq_keys[at] == words if len(freq_keys) else np.zeros(len(words), bool)
                gain, common = np.zeros(len(words)), hit[where]
                gain[hit] = base_of[at[hit]]
                base = np.bincount(doc, gain[where], one) - sizes * math.log10(floor)
                known = np.bincount(doc[common], minlength=one)
                chunk = chunk or Chunk(part.column(0)[0].as_py())
                yield record(one, chunk=pa.array(np.full(one, chunk.first)), doc=part.column(1), at=pa.array(np.arange(chunk.size, chunk.size + one)), n_tokens=pa.array(sizes, pa.int64()), known=pa.array(known, pa.int64()), base=pa.array(base), score=pa.array(score))
                rare_doc, rare = doc[~common], h[~common]
                order = np.lexsort((rare, rare_doc))
                rare_doc, rare = rare_doc[order], rare[order]
                new = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1])))) if len(rare) else np.zeros(0, np.int64)
                chunk.rare.append(((rare_doc[new] + chunk.size).astype(np.uint32), rare[new], np.diff(np.append(new, len(rare))).astype(np.uint32)))
                no_word, no_before = word_open & (q_word == 0), word_open & (context == 0)
                no_pair = pair_open & (q_pair == 0) & ((context > 0) | word_open)
                left = np.flatnonzero(no_word | no_before | no_pair)
                if len(left):                   # one entry for a pair of a document
                    left = left[np.lexsort((pairs[left], doc[left]))]
                    head = np.flatnonzero(np.concatenate(([True], (doc[left][1:] != doc[left][:-1]) | (pairs[left][1:] != pairs[left][:-1]))))
                    often, at = np.diff(np.append(head, len(left))), left[head]
                    chunk.open.append(((doc[at] + chunk.size).astype(np.uint32), pairs[at], often.astype(np.uint32), h[at], before[at], no_pair[at], no_word[at], no_before[at], *(x[at].astype(np.uint8) for x in (q_pair, q_word, q_before))))
                chunk.size, chunk.tokens = chunk.size + one, chunk.tokens + len(h)
                if chunk.tokens > chunk_tokens:
                    yield ended(chunk)
                    chunk = None
        if chunk:
            yield ended(chunk)

    kinds = dict(chunk="bigint", kind="int", bucket="int", keys="binary", doc=docs.schema["doc"].dataType.simpleString(), at="bigint", n_tokens="bigint", known="bigint", base="double", score="double")
    return docs.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kinds.items()))


def looked_up(scored: DataFrame, left_out: DataFrame, buckets: int) -> DataFrame:
    """``chunk, kind, bucket, counts, wide``: the counts that chunks ask for, in the order of their
    keys. The buckets of ``left_out`` may be more, by a factor."""

    def run(counts: pa.Table, asked: pa.Table) -> pa.Table:
        keys, n = summed(*read_counts(counts)) if counts.num_rows else (np.zeros(1, np.uint64), np.zeros(1, np.int64))
        wanted, sizes = values(asked.column("keys"), np.uint64), pc.binary_length(asked.column("keys")).to_numpy() // 8
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        data, wide = narrow(np.where(keys[at] == wanted, n[at], 0))
        found = cells(sizes * (8 if wide else 2), np.frombuffer(data, np.uint8))
        return pa.table([asked.column("chunk"), asked.column("kind"), asked.column("bucket"), found, pa.array([wide] * len(sizes), pa.bool_())], names=["chunk", "kind", "bucket", "counts", "wide"])

    asked = scored.where("kind > 0").select("chunk", "kind", "bucket", "keys")
    own = left_out.withColumn("bucket", F.col("bucket") % buckets)
    return own.groupBy("kind", "bucket").cogroup(asked.groupBy("kind", "bucket")).applyInArrow(run, "chunk bigint, kind int, bucket int, counts binary, wide boolean")


def corrected(scored: DataFrame, answers: DataFrame, share: np.ndarray, word: int, pair: int, n_train: int, vocabulary: int) -> DataFrame:
    """A row for each document: its scores with what was looked up."""
    floor = n_train + vocabulary + 1

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        packed_ = {k: b for k, b in zip(rows.column("kind").to_pylist(), rows.column("keys")) if k is not None}
        s = {n: np.frombuffer(packed_[-k].as_buffer(), t) for k, (n, t) in enumerate(STATE.items(), 1)}
        docs = rows.filter(pc.is_null(rows.column("kind"))).sort_by("at")

        def got(kind):
            own = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("bucket")
            if not pc.any(own.column("wide")).as_py():
                return values(own.column("counts"), np.uint16).astype(np.int64)
            return np.concatenate([np.frombuffer(c.as_buffer(), np.int64 if w else np.uint16).astype(np.int64) for c, w in zip(own.column("counts"), own.column("wide").to_pylist())])

        words, pairs = np.append(0, got(1)), got(2)                      # word 0 is one that is not asked for
        # the base: rare words
        doc, n = np.repeat(np.arange(docs.num_rows), s["rare_size"]), words[s["rare_word"]]
        base = docs.column("base").to_numpy() + np.bincount(doc, s["rare_times"] * np.log10(n + 1.0), docs.num_rows)
        known = docs.column("known").to_numpy() + np.bincount(doc[n > 0], s["rare_times"][n > 0], docs.num_rows).astype(np.int64)
        # the model: levels by exact counts where the filter has none
        exact = lambda q, n, below: np.where((n > 0) & (n < below), level(n), q).astype(np.uint8)
        found, low, context = s["found"].copy(), exact(s["low"], words[s["word"]], word), exact(s["context"], words[s["before"]], word)
        found[:len(pairs)] = exact(found[:len(pairs)], pairs, pair)
        before, after = (modelled(LOW[f], LOW[w], HIGH[c], share[s["share"]], floor) for f, w, c in ((s["found"], s["low"], s["context"]), (found, low, context)))
        doc = np.repeat(np.arange(docs.num_rows), s["size"])
        score = docs.column("score").to_numpy() + np.bincount(doc, s["times"] * (after - before)[s["pair"]], docs.num_rows)
        return pa.table([docs.column("doc"), docs.column("n_tokens"), pa.array(known), pa.array(np.full(docs.num_rows, n_train)), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = scored.schema["doc"].dataType.simpleString()
    held = scored.where("kind is null or kind < 0").drop("bucket")
    return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(docs: DataFrame, train_if, id_col: str = "doc_id", text_col: str = "text", filter_mb: float = FILTER_MB) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_known, train_tokens,
    base_score, score``. ``train_if`` is a condition on ``docs``; null counts as false.

    Null texts are empty: one token, the end. Repeated rows count and are scored as they
    stand. Without training texts every probability is one over one."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.coalesce(train_if, F.lit(False)).alias("train"))
    buckets = blocks(text_bytes(rows, "text"), BUCKET_BYTES * WAVES, 64 // WAVES) * WAVES
    with arrow_rows(spark, TEXT_ROWS):
        counts = stage(count_ngrams(rows.where("train").select("text"), buckets), "lm-counts")
    singles = unpacked(counts.where("kind = 1"))
    with arrow_rows(spark, BUCKET_ROWS):
        total = singles.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        sizes, share = level_sizes(counts), left_over(counts)
    word, pair, bits = choose(sizes, max(2, int(filter_mb * (1 << 23)) // (SECTIONS * 64)) * SECTIONS * 64)
    often = frequent_from(sizes)
    top = singles.where(F.col("c") >= often).toPandas()          # FREQUENT rows at most
    keys = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast({"filter": build(counts, word, pair, bits), "share": share, "word": word, "pair": pair, "n": total["n"], "v": total["v"], "keys": keys[order], "counts": top["c"].to_numpy(np.int64)[order]})
    numbered = lambda d: d.select(F.monotonically_increasing_id().alias("row"), "doc", "text")
    with arrow_rows(spark, BUCKET_ROWS):
        left_out = stage(outside(counts, word, pair, often), "lm-left")
    release(counts)
    waves, done = WAVES if word > 1 or pair > MIN_PAIR else 1, []
    for wave in range(waves):
        own = rows if waves == 1 else rows.where(F.pmod(F.xxhash64("doc", "text"), F.lit(waves)) == wave)
        with arrow_rows(spark, TEXT_ROWS):
            scored = stage(score_texts(numbered(own), shared, buckets // waves), "lm-scores")
        answers = looked_up(scored, left_out, buckets // waves)
        done.append(stage(corrected(scored, answers, share, word, pair, total["n"], total["v"]), "lm-scored"))
        release(scored)
    release(left_out)
    return functools.reduce(DataFrame.unionByName, done)
