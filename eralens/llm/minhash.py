"""Near-duplicates by min-max hashing.

A document is its set of distinct shingles of four words. Every permutation hashes the set
once and gives two values, its minimum and its maximum; with 30 permutations, 20 bands of
three values find a pair at the threshold but for one time in 1.6 million. Documents with
equal sets are one class before that. In a bucket, members are first compared with the
smallest; those still apart are compared with the members of other components that the
triangle inequality of the Jaccard distance leaves possible. So a bucket of many near copies
costs about one comparison a member, and no link is lost that a bucket holds. All
comparisons take the full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralens.llm.common import ASCII_LOWER, byte_texts, components, release, stage

WORDS = 4
BANDS, ROWS = 20, 3          # 30 permutations
PERMUTATIONS = 64             # drawn; more than any banding here uses
THRESHOLD = 80             # 100 * intersection >= THRESHOLD * union
KNOWN_WORDS = 500_000
BLOCK_SHINGLES = 1 << 16     # of the sets in a block
ODD = np.random.default_rng(7).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = np.random.default_rng(8).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


class Hashes(dict):
    """64-bit hashes by word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(memo: Hashes, raw: bytes) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z lowered."""
    words = raw.translate(ASCII_LOWER).split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_set(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words are one shingle, none give none."""
    n = len(hashes)
    if not n:
        return hashes
    size, out = min(words, n), np.full(max(1, n - words + 1), np.uint64(n if n < words else words), np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(out)])
    return np.unique(out)


def min_max(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key per band for each set (none empty). Every permutation is worked out once for
    all sets and gives both its minimum and its maximum; minima fill the first bands and
    maxima the last, so a band seldom holds both of one permutation. Keys depend on the
    band's number, so that bands never mix."""
    return banded(np.concatenate(sets), np.array([len(s) for s in sets]), bands, rows)


def banded(flat: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The same for sets in a row, of these sizes."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    half = -(-bands * rows // 2)
    values = np.empty((len(sizes), 2 * half), np.uint64)
    for k in range(half):
        h = mix(flat * ODD[k] + ADD[k])
        values[:, k], values[:, half + k] = np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts)
    values = values[:, : bands * rows].reshape(len(sizes), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sizes), bands))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
    return key


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc, text -> doc, shingles`` (packed 64-bit hashes)."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        memo = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingle_set(word_hashes(memo, t), words).tobytes() for t in byte_texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["doc", "shingles"])

    return docs.select("doc", "text").mapInArrow(run, f"doc {kind}, shingles binary")


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc, text -> doc, n_shingles, set_hash, bands``; without words, the last two null."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        memo = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [shingle_set(word_hashes(memo, t), words) for t in byte_texts(part.column(1))]
                full = [s for s in found if len(s)]
                keys = iter(min_max(full).view(np.int64) if full else ())
                bands = [next(keys) if len(s) else None for s in found]
                key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc", "n_shingles", "set_hash", "bands"])

    return docs.select("doc", "text").mapInArrow(run, f"doc {kind}, n_shingles bigint, set_hash binary, bands array<bigint>")


def jaccard(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``a, b -> a, b, both, either`` from the full sets in ``held(doc, shingles)``."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                n = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                both.append(n), either.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    left, right = held.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), held.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}, both bigint, either bigint")


def block_links(x: list[np.ndarray], y: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all linked pairs of two blocks of sets. Shingles that only one set has
    add nothing to an intersection and are left out; the others are columns of 0 and 1,
    multiplied some thousands at a time."""
    row = lambda sets: np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    fx, fy = np.concatenate(x), np.concatenate(y)
    if same:
        value, times = np.unique(fx, return_counts=True)
        shared = value[times > 1]
    else:
        shared = np.intersect1d(fx, fy)
    both = np.zeros((len(x), len(y)), np.float32)
    if len(shared):
        place = lambda flat: np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        px, py, rx, ry = place(fx), place(fy), row(x), row(y)
        kx, ky = shared[px] == fx, shared[py] == fy
        px, rx, py, ry = px[kx], rx[kx], py[ky], ry[ky]
        for at in range(0, len(shared), 4096):
            width = min(4096, len(shared) - at)
            mx, my = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
            ix, iy = (px >= at) & (px < at + width), (py >= at) & (py < at + width)
            mx[rx[ix], px[ix] - at] = 1
            my[ry[iy], py[iy] - at] = 1
            both += mx @ my.T
    both = both.astype(np.int64)
    if same:
        np.fill_diagonal(both, 0)
    either = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
    return np.nonzero((both > 0) & (both * 100 >= either * THRESHOLD))


def compared(blocks_: DataFrame, kind: str) -> DataFrame:
    """Links ``a, b`` within and between blocks of a group whose sizes allow them.
    ``blocks_``: ``part, crowd, bin, docs, sets``. A block pair gives a tree of its links."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                x, y = ([np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(c)[k].values] for c in (3, 5))
                i, j = block_links(x, y, one == two)
                if not len(i):
                    continue
                up = list(range(len(x) + (0 if one == two else len(y))))

                def root(v):
                    while up[v] != v:
                        up[v] = up[up[v]]
                        v = up[v]
                    return v

                a, b = [], []
                for p, q in zip(i.tolist(), (j if one == two else j + len(x)).tolist()):
                    if root(p) != root(q):
                        up[root(q)] = root(p)
                        a.append(p), b.append(q)
                docs = batch.column(2)[k].values
                docs = docs if one == two else pa.concat_arrays([docs, batch.column(4)[k].values])
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(a)), docs.take(pa.array(b))], names=["a", "b"])

    head = blocks_.select("part", "crowd", "bin")
    near = head.toDF("one", "crowd", "x").join(head.toDF("two", "crowd", "y"), "crowd").where((F.col("one") <= F.col("two")) & (F.abs(F.col("x") - F.col("y")) <= 2)).select("one", "two")
    load = lambda side, n: blocks_.select(F.col("part").alias(side), F.col("docs").alias(f"docs_{n}"), F.col("sets").alias(f"sets_{n}"))
    return near.join(load("two", "y"), "two").join(load("one", "x"), "one").select("one", "two", "docs_x", "sets_x", "docs_y", "sets_y").mapInArrow(run, f"a {kind}, b {kind}")


def linked(classes: DataFrame, held_sets, name: str, keys_first: bool = False) -> DataFrame:
    """Components of the link graph of classes: ``node, component`` for those with a link.

    ``classes``: ``doc, n_shingles, bands``. ``held_sets(ids)``: ``doc, shingles`` of these. With
    ``keys_first``, keys that several classes have are counted and stored before classes are
    joined with them, so that many small classes are on disk in one shuffle at a time, not in
    two, and only the key of an entry is in that one: the first class of a key is taken from
    what the join leaves. (A least struct would sort all entries, a count does not.)"""
    kind = classes.schema["doc"].dataType.simpleString()
    entry = classes.select("doc", "n_shingles", F.explode("bands").alias("key"))
    least = lambda rows: rows.groupBy("key").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if keys_first:
        many = stage(entry.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), f"{name}-keys")
        entry = stage(entry.join(many, "key"), f"{name}-repeated")
    bucket = stage(entry.join(stage(least(entry), f"{name}-lead") if keys_first else least(entry), "key"), f"{name}-buckets")          # key, doc, n_shingles, first
    if keys_first:
        release(entry)
    held = stage(held_sets(bucket.select("doc").distinct()), f"{name}-sets")
    # 1. with the first of each bucket; a pair that several buckets share counts once
    star = bucket.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    links = stage(jaccard(star, held).where(F.col("both") * 100 >= F.col("either") * THRESHOLD).select("a", "b"), f"{name}-first")
    comp = components(links, name)
    # 2. buckets that still hold several components; what they tie together is a crowd
    placed = bucket.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    apart = stage(placed.join(mixed, "key").select("doc", "n_shingles", "first").distinct(), f"{name}-apart")
    if apart.isEmpty():
        return comp
    crowd = components(apart.select(F.col("first").alias("a"), F.col("doc").alias("b")), name).select(F.col("node").alias("doc"), F.col("component").alias("crowd"))
    # Blocks of one crowd and range of sizes; sets more than two ranges apart cannot link.
    sized = apart.select("doc", "n_shingles").distinct().join(crowd, "doc").withColumn("bin", F.floor(F.log("n_shingles") / F.log(F.lit(1.125))).cast("int"))
    parts = sized.groupBy("crowd", "bin").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("parts"))
    cut = sized.join(parts, ["crowd", "bin"]).withColumn("part", F.xxhash64("crowd", "bin", F.pmod(F.xxhash64("doc"), F.col("parts"))))
    packed = stage(cut.join(held, "doc").groupBy("part", "crowd", "bin").agg(F.collect_list(F.struct("doc", "shingles")).alias("own"))
                   .select("part", "crowd", "bin", F.col("own.doc").alias("docs"), F.col("own.shingles").alias("sets")), f"{name}-blocks")
    more = compared(packed, kind)
    return components(stage(links.unionByName(more), f"{name}-links"), name)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, name: str = "near") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Empty and null texts have no shingles and link with nothing. A row without an id is its
    own component (null) and kept. Rows that repeat an id share its component."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    signed = stage(signatures(rows, words), f"{name}-signatures")
    known = signed.where("set_hash is not null and doc is not null")
    # equal sets: one class, under its smallest id; counted by combining, whatever its size
    same = known.groupBy("set_hash").agg(F.min("doc").alias("rep"))
    classes = stage(known.join(same, "set_hash").where("doc = rep").select("doc", "n_shingles", "bands", "set_hash").dropDuplicates(["doc", "set_hash"]), f"{name}-classes")
    comp = linked(classes, lambda ids: sets(rows.join(ids, "doc", "left_semi"), words).dropDuplicates(["doc"]), name)
    # an id that is repeated with another text joins the classes of all its texts
    label = same.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    out = signed.withColumn("set_hash", F.when(F.col("doc").isNotNull(), F.col("set_hash"))).join(label, "set_hash", "left").select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("component", "doc").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
