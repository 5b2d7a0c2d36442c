"""A prefix tree of conversations, by collapsing whole sequences.

Texts are hashed where they are read (128 bits, two hashes of 64) and never shuffled. A prefix
is named by its depth and the exclusive or of its turns' hashes, each hashed with its place,
so prefixes of all depths come from running sums that may be cut anywhere: a conversation is
handled in blocks of ``BLOCK`` turns, however long it is.

Identical conversations are one sequence with a weight and a list of those that end there;
everything after works on distinct sequences. A sequence that no other continues (anti-join
with all proper prefixes) is a leaf. Nodes are the weighted prefixes, aggregated map side first.

Sums over subtrees need no pairs of nodes and ancestors. A node belongs to the sequence of its
smallest member; the nodes of one sequence are the lower end of its path. Within it, sums run
upwards; above it, the whole sum of the sequence goes to each prefix once."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eralens.functions.ranking import AUTO, Plan, running_weight
from eralens.llm.common import stage

BLOCK = 4096
CHUNK_BITS = 12                       # ids of one end list are joined in ranges of 2**12 ids
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["d", "p1", "p2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(talks: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", plan: Plan = AUTO) -> DataFrame:
    """``conv, pos, h1, h2, words``: turns in order from 0, null turns first, equal ones by hash.
    Rows without an id take no part; null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = talks.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(text, F.lit(1), role).alias("h2"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    same = stage(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "trie-turns")
    placed = running_weight(same, ["conv"], ["turn", "h1", "h2"], F.col("n"), plan)
    return placed.select("conv", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("pos"), "h1", "h2", "words")


def share_heads(turns: DataFrame, each: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversation c starts with the first h turns of conversation c - c % ``each`` in place of
    its own first h, h being crc32 of c's digits modulo ``most``. Returns the new turns and all
    conversations (``conv``), those that are left without a turn too."""
    h, base = F.crc32(F.col("conv").cast("string").cast("binary")) % most, F.col("conv") - F.col("conv") % each
    heads = turns.where((F.col("pos") < most - 1) & (F.col("conv") % each == 0)).withColumnRenamed("conv", "base")
    sizes = heads.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    convs = stage(
        turns.select("conv").distinct().select("conv", h.alias("h"), base.alias("base")).join(sizes, "base", "left")
        .select("conv", "base", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("given")), "trie-convs")
    taken = convs.join(heads, "base").where("pos < given").select("conv", "pos", "h1", "h2", "words")
    short = convs.where("given < h").select("conv", (F.col("h") - F.col("given")).alias("missing"))
    own = turns.where(F.col("pos") >= h).join(short, "conv", "left").select("conv", (F.col("pos") - F.coalesce("missing", F.lit(0))).alias("pos"), "h1", "h2", "words")
    return taken.unionByName(own), convs.select("conv")


def running(rows: DataFrame, key: str, at: str, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds ``{name: (column, "bit_xor" or "sum")}`` over the rows of a key up to ``at``, a dense
    number: within blocks of ``BLOCK``, then each block shifted by those before it."""
    fold = {n: lambda c, how=how: getattr(F, how)(c) for n, (_, how) in sums.items()}
    join = {n: (lambda a, b: a.bitwiseXOR(b)) if how == "bit_xor" else (lambda a, b: a + b) for n, (_, how) in sums.items()}
    cut = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    within = Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    many = cut.groupBy(key, "_block").agg(*[fold[n](F.col(c)).alias(f"_{n}") for n, (c, _) in sums.items()])
    shift = many.select(key, "_block", *[fold[n](F.col(f"_{n}")).over(before).alias(f"_{n}") for n in sums]).where(" and ".join(f"_{n} is not null" for n in sums))
    out = cut.select("*", *[fold[n](F.col(c)).over(within).alias(f"_own_{n}") for n, (c, _) in sums.items()]).join(shift, [key, "_block"], "left")
    return out.select(*rows.columns, *[join[n](F.col(f"_own_{n}"), F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in sums])


def end_lists(whole: DataFrame) -> DataFrame:
    """``d, p1, p2, ends_sha256`` of the ids that end at a node, ascending, joined by commas. Ids
    are joined in ranges first; a node's ranges then stream through one hash."""
    chunks = whole.groupBy(*NODE, F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))

    def run(batches):
        key = state = None
        for batch in batches:
            done = []
            for *node, ids in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2), batch.column(3)))):
                if node == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
            yield pack(done)
        if key:
            yield pack([(*key, state.hexdigest())])

    def pack(done):
        d, p1, p2, sha = zip(*done) if done else ((), (), (), ())
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (d, p1, p2)), pa.array(sha, pa.string())], names=[*NODE, "ends_sha256"])

    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    return ordered.mapInArrow(run, "d bigint, p1 bigint, p2 bigint, ends_sha256 string")


def tree(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the prefix tree of ``turns(conv, pos, h1, h2, words)``: ``conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. ``convs(conv)``
    has all conversations, also those without turns. Without conversations there is no node."""
    terms = [F.xxhash64("pos", "h1").alias("x1"), F.xxhash64("h2", "pos").alias("x2")]
    turns = stage(turns.select("conv", "pos", "words", *terms), "trie-rebuilt")
    ended = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("d"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    zero = F.lit(0).cast("bigint")
    whole = stage(convs.join(ended, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in NODE]), "trie-whole")
    sequences = stage(whole.groupBy(*NODE).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("weight")), "trie-sequences")

    # paths of distinct sequences: every prefix with its weight and its parent
    chosen = sequences.select(F.col("rep").alias("conv"), "weight", F.col("d").alias("size"))
    steps = running(turns.join(chosen, "conv"), "conv", "pos", {"p1": ("x1", "bit_xor"), "p2": ("x2", "bit_xor")})
    below = steps.select(F.col("conv").alias("rep"), "weight", "size", (F.col("pos") + 1).alias("d"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "words")
    none = F.lit(None).cast("bigint")
    top = sequences.select("rep", "weight", F.col("d").alias("size"), zero.alias("d"), zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), zero.alias("words"))
    paths = stage(below.unionByName(top), "trie-paths")

    proper = paths.where("d < size").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("rep", F.lit(1).cast("bigint").alias("leaf"))
    nodes = stage(
        paths.join(leaves, "rep", "left").groupBy(*NODE).agg(
            F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.coalesce(F.sum("leaf"), zero).alias("n_leaves"),
            F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")

    owners = stage(nodes.groupBy("conv_id").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.sum("saved").alias("total")), "trie-owners")
    owned = nodes.join(owners, "conv_id").withColumn("up", F.col("last") - F.col("d"))
    owned = stage(running(owned, "conv_id", "up", {"subtree": ("saved", "sum")}), "trie-owned")
    above = paths.join(owners.select(F.col("conv_id").alias("rep"), "first", "total"), "rep").where("d < first")

    inner = owned.where("d > first").select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    outer = owned.where("d = first and d > 0").select(*NODE, "q1", "q2").join(parents, ["d", "q1", "q2"]).select(*NODE, "parent_conv_id")

    def fact(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*NODE, *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FACTS.items()])

    facts = fact(owned, conv_id=F.col("conv_id"), n_convs=F.col("n_convs"), n_leaves=F.col("n_leaves"), saved=F.col("subtree"))
    facts = facts.unionByName(fact(above.groupBy(*NODE).agg(F.sum("total").alias("total")), saved=F.col("total")))
    facts = facts.unionByName(fact(inner.unionByName(outer), parent_conv_id=F.col("parent_conv_id")))
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n"))
    facts = facts.unionByName(fact(children, n_children=F.col("n"))).unionByName(fact(end_lists(whole), ends=F.col("ends_sha256")))
    return facts.groupBy(*NODE).agg(
        F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.coalesce(F.max("n_children"), zero).alias("n_children"),
        F.max("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(NO_ENDS)).alias("ends_sha256"),
    ).select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


FACTS = {"conv_id": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved": "bigint", "ends": "string"}


def prefix_tree(talks: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared: tuple[int, int] | None = None, plan: Plan = AUTO) -> DataFrame:
    """The prefix tree of a table of turns; ``shared`` (each, most) rebuilds it by ``share_heads``
    first. Ids are whole numbers. Rows without an id take no part, repeated rows are turns of
    their own, null roles and texts are empty, other columns are not read, and an empty table
    has no node."""
    turns = stage(turn_rows(talks, id_col, turn_col, role_col, text_col, plan), "trie-placed")
    turns = turns.withColumn("conv", F.col("conv").cast("bigint"))
    return tree(*(share_heads(turns, *shared) if shared else (turns, turns.select("conv").distinct())))
