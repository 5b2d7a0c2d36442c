"""Secret scanning with ownership frequency over the whole corpus.

Candidates are fixed patterns and long mixed strings. Their values are hashed and counted
over distinct repositories and owners. A value that stands in several owners' texts is an
example that people copied; one that a single owner holds looks live."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralens.llm.common import stage, texts

# Fixed patterns: kinds, in the order in which ties are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "mixed")
MIN_ASSIGN, MIN_ACCESS, MIN_BITS = 6, 20, 3.5
EXAMPLE_OWNERS = 3        # a value of so many owners is a copied example
SCHEMA = "kind int, start int, stop int, value binary, base boolean"


def bits(s: str) -> float:
    """Entropy of a string's characters, in bits."""
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def candidates(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(kind, start, end, value, base), in code points; base ones by the fixed patterns,
    others are long strings of letters of both cases and digits that no base one covers."""
    out = [(0, m.start(), m.end(), m[2], True) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [(1, m.start(), m.end(), m[0], True) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(2, m.start(), m.end(), m[0], True) for m in HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b, _, _ in out)
    for m in MIXED.finditer(text):
        s = m[0]
        if re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s) and bits(s) >= MIN_BITS and not any(a < m.end() and m.start() < b for a, b in taken):
            out.append((3, m.start(), m.end(), s, False))
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def listed(spans: list[tuple[int, int, int, str, bool]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _, _ in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str | None = None) -> DataFrame:
    """Per row: ``row`` (a number of its own), ``doc_id, repo, owner, n_assign, n_access, n_hex, base_sha256, spans`` and
    ``found``, the spans with the hash of their value. Null text is empty; a null repository
    or owner is one of its own. Rows are counted as they stand, repeated or not."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"row bigint, doc_id {kind}, repo string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
              "found array<struct<kind:string,start:int,stop:int,value:binary>>")
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.binary())]))

    def run(batches):
        from pyspark import TaskContext

        done = TaskContext.get().partitionId() << 40
        for batch in batches:
            number = pa.array(range(done, done + batch.num_rows), pa.int64())
            done += batch.num_rows
            rows = [candidates(t) for t in texts(batch.column(3))]
            base = [[s for s in r if s[4]] for r in rows]
            count = lambda k: pa.array([sum(s[0] == k for s in r) for r in base], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [number, *batch.columns[:3], count(0), count(1), count(2), pa.array([hashlib.sha256(listed(r).encode()).hexdigest() for r in base]), pa.array([listed(r) for r in rows]),
                 pa.array([[{"kind": KINDS[k], "start": a, "stop": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest()} for k, a, b, v, _ in r] for r in rows], item)],
                names=["row", "doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    return docs.select(F.col(id_col).alias("id"), name(repo_col).alias("repo"), name(owner_col).alias("owner"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """``value, n_owners, n_repos, n_rows``. Counts by value, owner and repository combine
    before the shuffle, so that a value in a third of all rows is a few rows for each task."""
    each = found.select("repo", "owner", F.explode("found").alias("f")).select("repo", "owner", F.col("f.value").alias("value"))
    by_repo = each.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str | None = None) -> DataFrame:
    """One row per document: the columns of ``scan`` but ``found``, and ``n_live`` (spans
    whose value belongs to one owner), ``n_example`` (values of ``EXAMPLE_OWNERS`` owners or
    more), ``most_owners``. An empty table gives no rows."""
    seen = stage(scan(docs, id_col, text_col, repo_col, owner_col), "secrets")
    spread = ownership(seen)
    judged = (seen.select("row", F.explode("found").alias("f")).select("row", F.col("f.value").alias("value")).join(spread, "value")
              .groupBy("row").agg(F.count_if(F.col("n_owners") == 1).alias("n_live"), F.count_if(F.col("n_owners") >= EXAMPLE_OWNERS).alias("n_example"), F.max("n_owners").alias("most_owners")))
    zero = F.lit(0).cast("bigint")
    clear = seen.where(F.size("found") == 0).select("*", zero.alias("n_live"), zero.alias("n_example"), zero.alias("most_owners"))
    return seen.where(F.size("found") > 0).join(judged, "row").unionByName(clear).drop("row", "found", "repo", "owner")
