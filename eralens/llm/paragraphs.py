"""Near-duplicate paragraphs by MinHash banding, and repeated passages across their borders.

Paragraphs are lines that are not blank. Equal ones (words in lower case, or marks where a
line has no words) are a class; classes of ``WORDS`` words or more are compared as sets of
shingles of so many words, shorter ones are repeated only if equal. Bands and rows are tuned: the
most rows whose bands still find a pair at the threshold with the recall asked for, within
a budget of hashes. Colliding classes are verified by exact Jaccard, links are closed to
components, and in each component all paragraphs but the first go. A component counts only
if two documents hold it.

Passages are runs of ``PASSAGE`` words that stand in two documents, wherever lines begin or
end. Of every ``PASSAGE - ANCHOR + 1`` runs of ``ANCHOR`` words in a row the one with the least
hash is an anchor, so that a passage holds the same anchor in all its documents. Passages of one
anchor stand in a row; where all documents hold the same words there, they are settled
together, and where they differ, every run of ``PASSAGE`` words is compared by its hash: no
passage is missed."""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eralens.llm.common import release, stage, texts
from eralens.llm.minhash import banded, linked, mix, shingle_set

WORDS, THRESHOLD = 5, 80
RECALL, BUDGET = 0.9999993, 64     # 20 bands of 3, as in minhash
PASSAGE, ANCHOR = 50, 25
WORD = re.compile(r"\w+")
NODE = "struct<doc:{kind},para:int>"


def tuned(threshold: float = THRESHOLD / 100, recall: float = RECALL, budget: int = BUDGET) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall within the budget."""
    best = (budget, 1)
    for rows in range(1, budget + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= budget:
            best = (bands, rows)
    return best


BANDS, ROWS = tuned()


@functools.cache
def word_chars() -> np.ndarray:
    """By code point: does it belong to a word?"""
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def letters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def words_at(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words in a row, in lower case, the words' lengths, and where they start and
    stop in the text, in code points."""
    low = text.lower()
    letters = letters_of(low)
    inside = word_chars()[letters]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, stop = edges[::2], edges[1::2]
    letters, size = letters[inside], stop - start
    if len(low) != len(text):                # letters that become two: places are those of the letters they come from
        back = np.array([k for k, c in enumerate(text) for _ in c.lower()])
        start, stop = back[start], back[stop - 1] + 1
    return letters, size, start, stop


def hashed(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: sums of their letters, each hashed with its place in the word."""
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    each = mix(letters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return mix(np.add.reduceat(each, first) + size.astype(np.uint64))


def hashed_list(words: list[str]) -> np.ndarray:
    return hashed(letters_of("".join(words)), np.fromiter(map(len, words), np.int64, len(words)))


def hashed_texts(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts (as of ``words_at``), and how many each has."""
    return hashed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])), np.array([len(f[1]) for f in found])


def lines(text: str, starts: np.ndarray) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, list[str]]]]:
    """(number, start, stop, words) of the lines that have some, and the same, with their marks
    as words, of lines that have none and are not blank."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at)
        at = text.find("\n", at + 1)
    first, last = np.array([0, *(e + 1 for e in ends)]), np.array([*ends, len(text)])
    size = np.diff(np.r_[np.searchsorted(starts, first), len(starts)])
    some = np.flatnonzero(size)
    bare = [(k, a, b, marks) for k, a, b in zip(*(x[size == 0].tolist() for x in (np.arange(len(size)), first, last))) if b > a and (marks := text[a:b].split())]
    return list(zip(some.tolist(), first[some].tolist(), last[some].tolist(), size[some].tolist())), bare


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words, put together from runs of powers of two."""
    join = lambda a, b, by: mix(a[: len(b) - by] * np.uint64(0x9E3779B97F4A7C15) + b[by:])
    out, size, power, width = None, 0, h, 1
    while True:
        if n & width:
            out, size = (power if out is None else join(out, power, size)), size + width
        if 2 * width > n:
            return out
        power, width = join(power, power, width), 2 * width


def anchors(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchors of texts in a row (of these sizes, in words), and the first and last
    start of the passages that have each as theirs. A passage has one anchor, the first run
    of least hash in it."""
    if len(h) < PASSAGE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    each, width = runs(h, ANCHOR), PASSAGE - ANCHOR + 1
    at, held = np.arange(len(each)), 1                       # place of the least of ``held`` runs from here on
    while held < width:
        step = min(held, width - held)
        a, b = at[:-step], at[step:]
        at, held = np.where(each[b] < each[a], b, a), held + step
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(owner[: len(at)] == owner[PASSAGE - 1:])
    at = at[start]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
    return each[at[first]], start[first], start[np.r_[first[1:], len(at)][: len(first)] - 1]


def many_sets(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of many paragraphs of five words or more in one go: distinct shingles, paragraph
    by paragraph, and how many each has. The same values as of ``shingle_set``."""
    out = np.full(len(flat) - WORDS + 1, np.uint64(WORDS))
    for k in range(WORDS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + flat[k:k + len(out)])
    owner = np.repeat(np.arange(len(size)), size)
    inside = owner[: len(out)] == owner[WORDS - 1:]
    out, owner = out[inside], owner[: len(out)][inside]
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.concatenate(([True], (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])))
    return out[new], np.bincount(owner[new], minlength=len(size))


SCAN = ["node", "start", "stop", "n_words", "same", "n_shingles", "bands", "anchors"]
SCAN_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())]


def scan(docs: DataFrame) -> DataFrame:
    """``doc, text`` -> ``node, start, stop, n_words, same, n_shingles, bands, anchors``;
    fewer than ``WORDS`` words have no bands. Anchors have a row for each document, with no
    more than the id."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from scanned(batch.slice(at, 256).column(0), texts(batch.slice(at, 256).column(1)))

    def scanned(ids, given):
        found = [words_at(t) for t in given]
        flat, n_words = hashed_texts(found)
        worded, bare = zip(*(lines(t, f[2]) for t, f in zip(given, found)))
        keys, first, _ = anchors(flat, n_words)
        stops = np.cumsum(n_words)
        bounds = np.r_[0, np.searchsorted(first, stops)]
        held = [np.unique(keys[a:b]).view(np.int64) for a, b in zip(bounds, bounds[1:])]
        some = [k for k, x in enumerate(held) if len(x)]
        if some:
            node = pa.StructArray.from_arrays([ids.take(pa.array(some)), pa.nulls(len(some), pa.int32())], names=["doc", "para"])
            yield pa.RecordBatch.from_arrays([node, *(pa.nulls(len(some), t) for t in SCAN_TYPES), pa.array([held[k] for k in some], pa.list_(pa.int64()))], names=SCAN)
        rows = [(k, *line) for k, own in enumerate(worded) for line in own] + [(k, para, a, b, len(marks)) for k, own in enumerate(bare) for para, a, b, marks in own]
        if not rows:
            return
        flat = np.concatenate((flat, hashed_list([w for own in bare for *_, marks in own for w in marks])))
        k, para, start, stop, n = (np.array(c) for c in zip(*rows))
        ends = np.cumsum(n)
        same = [xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in zip((ends - n).tolist(), ends.tolist())]
        node = pa.StructArray.from_arrays([ids.take(pa.array(k)), pa.array(para, pa.int32())], names=["doc", "para"])
        long = n >= WORDS
        sizes, bands = np.ones(len(n), np.int64), [None] * len(n)
        if long.any():
            distinct, sizes[long] = many_sets(flat[np.repeat(long, n)], n[long])
            found = iter(banded(distinct, sizes[long], BANDS, ROWS).view(np.int64))
            bands = [next(found) if x else None for x in long]
        yield pa.RecordBatch.from_arrays(
            [node, pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(n, pa.int32()), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.nulls(len(rows), pa.list_(pa.int64()))],
            names=SCAN)

    return docs.select("doc", "text").mapInArrow(run, f"node {NODE.format(kind=kind)}, start int, stop int, n_words int, same binary, n_shingles bigint, bands array<bigint>, anchors array<bigint>")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingles of the paragraphs in ``ids(doc)``, where ``doc`` is a paragraph."""
    kind = docs.schema["doc"].dataType.simpleString()
    wanted = ids.groupBy(F.col("doc.doc").alias("doc")).agg(F.collect_set("doc.para").alias("paras"))

    def run(batches):
        for batch in batches:
            at, para, words = [], [], []
            for k, (text, paras) in enumerate(zip(texts(batch.column(1)), batch.column(2).to_pylist())):
                rows = text.split("\n")
                for number in set(paras):
                    line = rows[number].lower() if number < len(rows) else ""
                    if own := WORD.findall(line) or line.split():
                        at.append(k), para.append(number), words.append(own)
            h, ends = hashed_list([w for own in words for w in own]), np.cumsum([len(own) for own in words], dtype=np.int64)
            sets = [shingle_set(h[b - len(own):b], WORDS).tobytes() for own, b in zip(words, ends.tolist())]
            node = pa.StructArray.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(para, pa.int32())], names=["doc", "para"])
            yield pa.RecordBatch.from_arrays([node, pa.array(sets, pa.binary())], names=["doc", "shingles"])

    return docs.join(wanted, "doc").select("doc", "text", "paras").mapInArrow(run, f"doc {NODE.format(kind=kind)}, shingles binary").dropDuplicates(["doc"])


def isin_pairs(pairs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which columns of ``pairs`` are columns of ``known``."""
    both = np.concatenate((pairs, known), axis=1)
    order = np.lexsort(both[::-1])
    new = np.r_[True, (both[:, order][:, 1:] != both[:, order][:, :-1]).any(axis=0)]
    number = np.empty(both.shape[1], np.int64)
    number[order] = np.cumsum(new)
    return np.isin(number[: pairs.shape[1]], number[pairs.shape[1]:])


def anchored(docs: DataFrame, wanted: DataFrame, single: bool) -> DataFrame:
    """Passages of the anchors in ``wanted(doc, keys)``: ``doc, body, key, run, first, last, start,
    stop, again``. One row has all passages of an anchor, from word ``first`` to word ``last``, and
    ``run`` is the hash of their words; with ``single``, one row has one passage. ``body`` tells
    texts of an id apart; ``again``: the text had the same before."""
    kind = docs.schema["doc"].dataType.simpleString()
    names = ["doc", "body", "key", "run", "first", "last", "start", "stop", "again"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from placed(batch.slice(at, 256))

    def placed(part):
        found = [words_at(t) for t in texts(part.column(1))]
        h, n = hashed_texts(found)
        starts, stops, begins = [f[2] for f in found], [f[3] for f in found], np.cumsum(n) - n
        keys, first, last = anchors(h, n)
        keys, owner = keys.view(np.int64), np.repeat(np.arange(len(n)), n)[first]
        # of each text, the anchors asked for
        lists = part.column(2)
        asked = np.stack((np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()))
        some = isin_pairs(np.stack((owner, keys)), asked)
        keys, first, last, owner = keys[some], first[some], last[some], owner[some]
        if not len(keys):
            return
        if single:
            size = last - first + 1
            keys, owner = np.repeat(keys, size), np.repeat(owner, size)
            first = last = np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(keys))
            run_ = runs(h, PASSAGE)[first]
        else:
            run_ = np.fromiter((xxhash.xxh3_64_intdigest(h[a:b + PASSAGE].tobytes()) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(keys))
        run_ = run_.view(np.int64)
        order = np.lexsort((first, run_, keys, owner))
        new = np.r_[True, (owner[order][1:] != owner[order][:-1]) | (keys[order][1:] != keys[order][:-1]) | (run_[order][1:] != run_[order][:-1])]
        again = np.empty(len(keys), bool)
        again[order] = ~new
        bodies = np.array([xxhash.xxh3_64_intdigest(h[a:a + m].tobytes()) for a, m in zip(begins.tolist(), n.tolist())], np.uint64).view(np.int64)
        start, stop = np.concatenate(starts)[first], np.concatenate(stops)[last + PASSAGE - 1]
        first, last = first - begins[owner], last - begins[owner]
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(owner)), pa.array(bodies[owner]), pa.array(keys), pa.array(run_), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
             pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(again)], names=names)

    return docs.join(wanted, "doc").select("doc", "text", "keys").mapInArrow(run, f"doc {kind}, body bigint, key bigint, run bigint, first int, last int, start int, stop int, again boolean")


def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, low, differ``: keys that two documents hold, the smallest one, and whether the rows
    of a key differ in their run. Stored, as only then a join with it can split a key that
    very many documents hold."""
    some = rows.groupBy(*keys).agg(F.min("doc").alias("low"), F.max("doc").alias("high"), (F.min("run") < F.max("run")).alias("differ"))
    return stage(some.where("low <> high").select(*keys, "low", "differ"), "passage-keys")


def passages(docs: DataFrame, held: DataFrame) -> DataFrame:
    """``doc, start, stop, n_words, low, again``: stretches of passages in a row whose smallest
    document is ``low``. ``held``: ``doc, anchors``.

    Where all documents hold the same words around an anchor, its passages are settled at
    once, by one row a document; only where they differ are single passages compared."""
    keys = held.select("doc", F.explode("anchors").alias("key"))
    once = keys.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high")
    wanted = keys.join(stage(once.select("key"), "passage-anchors"), "key").groupBy("doc").agg(F.collect_set("key").alias("keys"))
    found = stage(anchored(docs, wanted, False), "passage-runs")
    common = shared(found, ["key"])
    whole = found.join(common.where("not differ").drop("differ"), "key")
    unlike = found.select("doc", "key").distinct().join(common.where("differ").select("key"), "key").groupBy("doc").agg(F.collect_set("key").alias("keys"))
    alone = stage(anchored(docs, unlike, True), "passage-single")
    shares = shared(alone, ["key", "run"])
    parts = alone.join(shares.drop("differ"), ["key", "run"])
    names = ["doc", "body", "low", "again", "first", "last", "start", "stop"]
    marked = whole.select(names).unionByName(parts.select(names)).distinct()
    # stretches: what begins after the end of all before it begins a new one
    order = Window.partitionBy("doc", "body", "low", "again").orderBy("first")
    new = F.col("first") > F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    row = F.sum(F.when(F.col("new"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = stage(marked.withColumn("new", new).withColumn("stretch", row).groupBy("doc", "body", "low", "again", "stretch").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("last") - F.min("first") + PASSAGE).alias("n_words")).select("doc", "start", "stop", "n_words", "low", "again"), "passage-spans")
    release(found, common, alone, shares)
    return spans


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated paragraph or passage, the kept ones too: ``doc_id, para, start,
    stop, n_words, first_doc_id, first_para, removed``.

    Passages have no ``para`` and may overlap paragraphs and each other; of each, the first
    in the smallest document stays.

    Null and empty texts have no paragraphs; rows without an id take no part. Rows that
    repeat an id are one document; with other texts, one paragraph of a number stands for
    all of that number."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    scanned = stage(scan(rows), "paragraphs")
    across = passages(rows, scanned.where("anchors is not null").select("node.doc", "anchors"))
    same = scanned.where("same is not null").groupBy("same").agg(F.min("node").alias("rep"), F.min("node.doc").alias("low"), F.max("node.doc").alias("high"))
    classes = stage(scanned.join(same, "same").where("node = rep").select(F.col("node").alias("doc"), "n_shingles", "bands", "same", "low", "high").dropDuplicates(["doc"]), "paragraph-classes")
    seen = stage(scanned.where("same is not null").select("node", "start", "stop", "n_words", "same"), "paragraph-places")
    release(scanned)
    comp = linked(classes.select("doc", "n_shingles", "bands"), lambda ids: sets_of(rows, ids), "paragraph-links", keys_first=True)
    placed = classes.select("doc", "same", "low", "high").join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("same", "low", "high", F.coalesce("component", "doc").alias("first"))
    many = placed.groupBy("first").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("first")
    label = stage(placed.join(many, "first").select("same", "first"), "paragraph-labels")
    lines = seen.join(label, "same").select(
        F.col("node.doc").alias("doc_id"), F.col("node.para").alias("para"), "start", "stop", "n_words", F.col("first.doc").alias("first_doc_id"), F.col("first.para").alias("first_para"), (F.col("node") != F.col("first")).alias("removed"))
    none = F.lit(None).cast("int")
    return lines.unionByName(across.select(F.col("doc").alias("doc_id"), none.alias("para"), "start", "stop", "n_words", F.col("low").alias("first_doc_id"), none.alias("first_para"), ((F.col("doc") != F.col("low")) | F.col("again")).alias("removed")))
