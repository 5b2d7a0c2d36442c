"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words are maximal runs of Latin letters. Two words that differ by one inserted, deleted or
replaced letter have letter counts whose squared distance is at most two, and lengths that
differ by at most one. So words are dealt to blocks by length and by how many of their letters
fall into each of ``GROUPS`` sets of letters; one edit moves one letter into, out of or between
sets, so a word's near words are in its own block or in one of the few next to it, and blocks
farther apart are never compared. In a block, one product of the two matrices of letter counts
gives all squared distances, |a|^2 + |b|^2 - 2ab; what is left at two or less is verified letter
by letter. Blocks are bounded: a block of more than ``BLOCK`` words is cut into parts that are
compared pair by pair, and the words next to a block stream past it.

Words of one letter code per byte (Latin-1) travel as bytes, so byte order is code-point order."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralens.llm.common import ASCII_LOWER, stage, texts

RUN = re.compile(rb"[a-z\xc0-\xff]+")
MIN_LETTERS, MIN_COUNT, RATIO, TYPO = 6, 5, 5, 199
GROUPS, BLOCK = 8, 4096
HELD = 400_000                                   # distinct words a task counts before it passes them on
LETTERS = [*range(97, 123), *range(65, 91), *range(192, 256)]
COLUMN = np.full(256, -1)
COLUMN[LETTERS] = np.arange(len(LETTERS))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """``word, n``: runs of letters of all texts, A-Z in lower case, with their occurrences.

    Where ``typo`` divides the crc32 of ``<id>:<run>``, the run loses one letter, which the
    remainder of that crc32 names. A row without an id counts with an empty one."""
    def run(batches):
        total = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                found = RUN.findall(text.encode("latin-1", "replace").translate(ASCII_LOWER))
                total.update(found)
                start = zlib.crc32((key or "").encode() + b":")
                for w in set(found):
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % typo == 0:
                        n, at = found.count(w), h % len(w)
                        total[w] -= n
                        total[w[:at] + w[at + 1:]] += n
            if len(total) > HELD:
                yield flush(total)
        if total:
            yield flush(total)

    def flush(total):
        kept = {w: n for w, n in total.items() if n and len(w) >= min_letters}
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

    given = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words in a row, and the words' lengths."""
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


def letter_counts(words: list[bytes], group: np.ndarray | None = None) -> np.ndarray:
    """Words by letters, or by sets of letters, where ``group`` gives each letter's."""
    codes, size = flat(words)
    column = COLUMN[codes] if group is None else group[codes]
    width = len(LETTERS) if group is None else GROUPS
    return np.bincount(np.repeat(np.arange(len(words)), size) * width + column, minlength=len(words) * width).reshape(len(words), width)


def letter_groups(words: DataFrame) -> np.ndarray:
    """The set of each letter: the most frequent letter goes to the set that is least full."""
    def run(batches):
        for batch in batches:
            codes, n = np.unique(np.frombuffer("".join(batch.column(0).to_pylist()).encode("latin-1"), np.uint8), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(n)], names=["code", "n"])

    rows = words.select("word").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()   # one row a letter
    group, load = np.zeros(256, np.int64), [0] * GROUPS
    for r in sorted(rows, key=lambda r: (-r["n"], r["code"])):
        g = load.index(min(load))
        group[r["code"]] = g
        load[g] += r["n"]
    return group


def block_keys(sums: np.ndarray) -> list[bytes]:
    """Bytes that name a block, from its letters in each set."""
    small = np.ascontiguousarray(sums, np.uint8).tobytes()
    return [small[k * GROUPS:(k + 1) * GROUPS] if s < 256 else row.astype("<u4").tobytes() for k, (s, row) in enumerate(zip(sums.max(axis=1).tolist(), sums))]


def dealt(words: DataFrame, group: np.ndarray) -> DataFrame:
    """``key, guest, word, n``: each word in its own block, and as a guest in those next to it
    that hold words one letter longer, or as long with one letter moved to a later set, so
    that two blocks meet once."""
    moves = [(None, j) for j in range(GROUPS)] + [(i, j) for i in range(GROUPS) for j in range(i + 1, GROUPS)]

    def run(batches):
        for batch in batches:
            strings = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            word, n = pa.array(strings, pa.binary()), batch.column(1)
            sums = letter_counts(strings, group)
            yield rows(block_keys(sums), False, word, n)
            for i, j in moves:
                at = np.arange(len(sums)) if i is None else np.flatnonzero(sums[:, i])
                if len(at):
                    near = sums[at]
                    near[:, j] += 1
                    if i is not None:
                        near[:, i] -= 1
                    yield rows(block_keys(near), True, word.take(pa.array(at)), n.take(pa.array(at)))

    def rows(keys, guest, word, n):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([guest] * len(keys)), word, n], names=["key", "guest", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key binary, guest boolean, word binary, n bigint")


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of two letter matrices differ by one replaced letter, or, where the second
    is one letter wider, by one that the first lacks."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    before = np.cumprod(short == long[:, :-1], axis=1).sum(axis=1)
    after = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= short.shape[1]


class Block:
    """Words of one length with their Gram products."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        self.n, self.words = n, np.array(words, object)
        codes, size = flat(words)
        self.letters = codes.reshape(len(words), size[0])
        kind = np.float32 if size[0] < 2048 else np.float64            # squares of counts stay exact
        self.counts = letter_counts(words).astype(kind)
        self.square = (self.counts * self.counts).sum(axis=1)

    def near(self, other: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(own, other) rows one edit apart; each pair once if both are the ``same``."""
        own, theirs, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], max(1, (1 << 22) // len(self.n))
        for at in range(0, len(other.n), step):
            part = slice(at, at + step)
            apart = self.square[:, None] + other.square[None, part] - 2 * (self.counts @ other.counts[part].T)
            a, b = np.nonzero((apart <= 2) & (apart > 0))
            b += at
            if same:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 1 << 18):
                x, y = a[k:k + (1 << 18)], b[k:k + (1 << 18)]
                short, long = (other.letters[y], self.letters[x]) if other.letters.shape[1] < self.letters.shape[1] else (self.letters[x], other.letters[y])
                good = one_edit(short, long)
                own.append(x[good]), theirs.append(y[good])
        return np.concatenate(own), np.concatenate(theirs)


def best_of(to: Block, at: np.ndarray, other: Block, their: np.ndarray) -> list[tuple[bytes, int, int, bytes]]:
    """(word, near words, count and word of the most frequent one), one for each word of ``to``."""
    order = np.lexsort((np.argsort(np.argsort(other.words, kind="stable"))[their], -other.n[their], at))
    at, their = at[order], their[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
    size = np.diff(np.r_[first, len(at)])
    return list(zip(to.words[at[first]], size.tolist(), other.n[their[first]].tolist(), other.words[their[first]]))


def compare(placed: DataFrame) -> DataFrame:
    """``word, n_near, n, near`` by block, from rows in order of block, own words first."""
    def run(batches):
        key, home, block = None, [], None

        def own():
            nonlocal block
            if block is None and home:
                block = Block([w for ws, _ in home for w in ws], np.concatenate([n for _, n in home]))
                a, b = block.near(block, True)
                return best_of(block, np.r_[a, b], block, np.r_[b, a])
            return []

        def pack(found):
            word, size, n, near = zip(*found) if found else ((), (), (), ())
            names = [pa.array([w.decode("latin-1") for w in x], pa.string()) for x in (word, near)]
            return pa.RecordBatch.from_arrays([names[0], pa.array(size, pa.int64()), pa.array(n, pa.int64()), names[1]], names=["word", "n_near", "n", "near"])

        for batch in batches:
            found = []
            keys, parts, guests = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            words, n = batch.column(3).to_pylist(), batch.column(4).to_numpy()
            turns = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1] or parts[k] != parts[k - 1] or guests[k] != guests[k - 1]]
            for a, b in zip(turns, [*turns[1:], len(keys)]):
                if (keys[a], parts[a]) != key:
                    found += own()
                    key, home, block = (keys[a], parts[a]), [], None
                if not guests[a]:
                    home.append((words[a:b], n[a:b]))
                    continue
                found += own()
                if block is not None:
                    short = len(block.words[0]) - 1
                    for size in (short, short + 1):
                        at = [k for k in range(a, b) if len(words[k]) == size]
                        if at:
                            other = Block([words[k] for k in at], n[at])
                            x, y = block.near(other, False)
                            if len(x):
                                found += best_of(block, x, other, y) + best_of(other, y, block, x)
            yield pack(found)
        yield pack(own())

    return placed.mapInArrow(run, "word string, n_near bigint, n bigint, near string")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best``: for words of ``words(word, n)`` that have near ones, how many,
    and the most frequent (``best.n`` is minus its count; ties: the smallest word)."""
    group = letter_groups(words)
    rows = stage(dealt(words, group), "spelling-dealt")
    large = stage(rows.where("not guest").groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("parts")), "spelling-large")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    cut = rows.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.when(~F.col("guest"), own))
    # a part's own words are guests of all later parts of their block; guests visit all parts
    cut = cut.withColumn("part", F.explode(F.sequence(F.coalesce("own", F.lit(0)), F.col("parts") - 1)))
    cut = cut.select("key", "part", (F.col("guest") | (F.col("part") != F.col("own"))).alias("guest"), "word", "n")
    placed = cut.repartition("key", "part").sortWithinPartitions("key", "part", "guest")
    return compare(placed).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("word"))).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` from ``links(word, form)`` without circles: pointers double until they
    rest, so a chain of k forms takes log k rounds."""
    up = stage(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        jumped = stage(up.join(higher, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "spelling-roots")
        up = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return up


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
             ratio: int = RATIO, typo: int = TYPO, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, one row per word of ``min_letters`` letters and
    ``min_count`` occurrences.

    A word's form is its most frequent near word (ties: the smallest in code-point order), if
    that has at least ``ratio`` times the word's occurrences, else null; ``root`` ends the
    chain of forms. Null and empty texts hold no words, repeated rows count again, an empty
    table gives an empty result, other columns are not read."""
    words = stage(count_words(docs, id_col, text_col, min_letters, min_count, typo), "spelling-words")
    near = near_words(words, block)
    form = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.word"))
    formed = stage(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n")), "spelling-forms")
    tops = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(tops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
