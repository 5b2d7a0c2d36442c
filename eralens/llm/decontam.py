"""Benchmark decontamination: every passage of every document is a BM25 query against an
inverted index of the test items; those above a threshold are verified word by word.

Scores are shares of an item's score for its own text, so that one threshold serves items of
any length. A document is read in half-overlapping windows, each twice as long as the
longest item, so that an item lies whole in one of them. The bounds of a window go from
cheap to exact, as in block-max WAND: the sum of its terms' maxima; the sum of their block
maxima for each block of items; the scores of items in blocks that are left. No window
whose score could reach the threshold is passed over. The verification takes the shingles
of five words of question and answer (the item's last sentence, or last third).

The index is broadcast. Its size is bounded by reading the items in blocks of
``block_items`` items and ``block_bytes`` bytes at most on average, each against all rows;
term statistics are those of the block."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralens.llm.common import blocks, texts

BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
THRESHOLD = 0.5            # of the score of an item for its own text
SHINGLE, OVERLAP = 5, 0.8
K1, B = 1.2, 0.75
PER_BLOCK = 16             # items in a block of the index
CELLS = 1 << 18            # scores, of items in windows, that are summed at once
WORD = re.compile(r"\w+")
MATCH = "array<struct<item_id:{kind},score:double,question_overlap:double,answer_overlap:double,start_word:int,end_word:int>>"


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """Distinct runs of so many words; none if there are fewer."""
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before the last sentence and of it; of one sentence, the last third answers."""
    parts = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := WORD.findall(s.lower()))]
    if not parts:
        return [], []
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    cut = len(parts[0]) - max(1, len(parts[0]) // 3)
    return parts[0][:cut], parts[0][cut:]


class Index:
    """Postings by term with impacts, term maxima and block maxima, as flat arrays."""

    def __init__(self, items: list[tuple[object, str]]):
        words = [(i, w) for i, t in items if (w := WORD.findall((t or "").lower()))]
        self.ids = [i for i, _ in words]
        self.words = [w for _, w in words]
        # a part of fewer than five words is one run of its own length
        self.qa = [tuple((n := max(1, min(SHINGLE, len(p))), shingles(p, n)) for p in question_answer(t or "")) for _, t in items if WORD.search((t or "").lower())]
        self.longest = max((len(w) for w in self.words), default=1)
        n, mean = len(words), sum(map(len, self.words)) / max(1, len(words))
        df = Counter(t for w in self.words for t in set(w))
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.term = {t: k for k, t in enumerate(sorted(df))}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, w in enumerate(self.words):
            impact = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            own = sum(impact.values())
            for t, v in impact.items():
                postings[self.term[t]].append((i, v / own))
        self.length = np.array([len(postings[k]) for k in range(len(df))], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        flat = [p for k in range(len(df)) for p in postings[k]]
        self.item = np.array([p[0] for p in flat], np.int64)
        self.impact = np.array([p[1] for p in flat], float)
        block, most, sizes = [], [], []
        for k in range(len(df)):
            tops: dict[int, float] = {}
            for i, v in postings[k]:
                tops[i // PER_BLOCK] = max(v, tops.get(i // PER_BLOCK, 0.0))
            block += tops
            most += tops.values()
            sizes.append(len(tops))
        self.b_length = np.array(sizes, np.int64)
        self.b_start = np.concatenate(([0], np.cumsum(self.b_length)))[:-1]
        self.block, self.b_most = np.array(block, np.int64), np.array(most, float)
        self.n_blocks = -(-n // PER_BLOCK)
        # Terms in many items say little: they may leave out of the first bound what they can add to any item.
        self.upper = np.array([max((v for _, v in postings[k]), default=0.0) for k in range(len(df))])
        common, self.common = np.zeros(n), 0.0
        for k in sorted(range(len(df)), key=lambda k: -len(postings[k])):
            for i, v in postings[k]:
                common[i] += v
            if common.max(initial=0.0) > THRESHOLD / 2:
                break
            self.common = float(common.max(initial=0.0))
            self.upper[k] = 0.0
        self.upper = np.append(self.upper, 0.0)              # for words that no item has, numbered -1

    @staticmethod
    def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """All positions start..start+length of several ranges."""
        ends = np.cumsum(length)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)

    def retrieve(self, ids: np.ndarray, starts: np.ndarray, size: int):
        """``start, item, score`` of the items that score THRESHOLD or more in the windows from
        these starts on. Many windows are summed in one go, as far as their scores fit ``CELLS``."""
        n = max(1, len(self.ids))
        step = max(1, CELLS // n)
        for first in range(0, len(starts), step):
            begin = starts[first:first + step]
            width = np.minimum(begin + size, len(ids)) - begin
            own, window = ids[self.ranges(begin, width)], np.repeat(np.arange(len(begin)), width)
            known = own >= 0
            key = np.sort(window[known] * len(self.term) + own[known])       # distinct terms, window by window
            key = key[np.flatnonzero(np.diff(key, prepend=-1))]
            window = key // max(1, len(self.term))
            own = key - window * len(self.term)
            at = self.ranges(self.b_start[own], self.b_length[own])
            bound = np.bincount(np.repeat(window * self.n_blocks, self.b_length[own]) + self.block[at], self.b_most[at], len(begin) * self.n_blocks)
            alive = bound >= THRESHOLD - 1e-9
            some = alive.reshape(len(begin), self.n_blocks).any(axis=1)[window]
            window, own = window[some], own[some]
            at, window = self.ranges(self.start[own], self.length[own]), np.repeat(window, self.length[own])
            item = self.item[at]
            some = alive[window * self.n_blocks + item // PER_BLOCK]
            score = np.bincount(window[some] * n + item[some], self.impact[at[some]], len(begin) * n)
            for k in np.flatnonzero(score >= THRESHOLD - 1e-9).tolist():
                yield int(begin[k // n]), k % n, float(score[k])

    def matches(self, text: str) -> list[dict]:
        words = WORD.findall(text.lower())
        ids = np.fromiter(map(self.term.get, words, repeat(-1)), np.int64, len(words))
        size = 2 * self.longest
        total = np.concatenate(([0.0], np.cumsum(self.upper[ids])))
        starts = np.arange(0, max(1, len(words) - self.longest), self.longest)
        ends = np.minimum(starts + size, len(words))
        out: dict[object, dict] = {}
        for a, i, score in self.retrieve(ids, starts[total[ends] - total[starts] >= THRESHOLD - self.common - 1e-9], size):
            near = words[max(0, a - self.longest):a + size + self.longest]
            q, r = (len(s & shingles(near, n)) / len(s) if s else 1.0 for n, s in self.qa[i])
            if q >= OVERLAP and r >= OVERLAP and (self.ids[i] not in out or out[self.ids[i]]["score"] < score):
                out[self.ids[i]] = {"item_id": self.ids[i], "score": score, "question_overlap": q, "answer_overlap": r, "start_word": a, "end_word": min(a + size, len(words))}
        return list(out.values())


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The items, a bounded block at a time."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(blocks(n, BLOCK_ITEMS), blocks(size, BLOCK_BYTES))
    for k in range(parts):
        yield [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()]


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", drop: bool = False) -> DataFrame:
    """All columns and ``bench_matches``; with ``drop``, rows that match no item, and no new
    column. Null and empty texts and items match nothing; an empty benchmark, neither. A column
    ``bench_matches`` of the input gives way to the new one, and stays with ``drop``."""
    spark = docs.sparkSession
    match = MATCH.format(kind=benchmark.schema[item_col].dataType.simpleString())
    out = docs if drop else docs.withColumn("bench_matches", F.from_json(F.lit("[]"), match))
    at = docs.columns.index(text_col)
    for items in item_blocks(benchmark, item_col, item_text):
        index = spark.sparkContext.broadcast(Index(items))
        schema = ", ".join(f"`{n}` {t}" for n, t in out.dtypes)

        def run(batches, index=index):
            own = index.value
            for batch in batches:
                found = [own.matches(t) if t and own.ids else [] for t in texts(batch.column(at))]
                if drop:
                    yield batch.filter(pa.array([not x for x in found], pa.bool_()))
                    continue
                before = batch.column("bench_matches")
                both = pa.array([(b or []) + x for b, x in zip(before.to_pylist(), found)], before.type)
                yield pa.RecordBatch.from_arrays([both if n == "bench_matches" else c for n, c in zip(batch.schema.names, batch.columns)], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """One row per document and item that it holds: ``doc_id, item_id, score,
    question_overlap, answer_overlap, start_word, end_word``."""
    text = names.get("text_col", "text")
    found = find(docs.select(F.col(id_col).alias("doc_id"), text), benchmark, **names)
    return found.where(F.size("bench_matches") > 0).select("doc_id", F.inline("bench_matches"))
