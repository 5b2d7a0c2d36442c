"""Toxicity by maximum-scoring segments.

Token log-odds of toxic against clean texts with an informative Dirichlet prior (the
token's share of both) make a text a walk that drifts down and jumps up at telling tokens.
A linear scan finds all its maximal segments. Their scores follow an extreme-value law on
clean texts: ``lambda`` solves E[exp(lambda * s)] = 1 over clean tokens, ``K`` comes from
clean texts, and a segment counts if it is expected less than ``e_value`` times in a text of
that length. Two sums of calibrated scores go through a logistic curve fitted on labelled
texts that the lexicon has not seen.

Words that were never seen toxic can begin like ones that were: features are a word and its
beginnings of 4 to 6 letters, the longest significant one speaks.

The model is fitted on a bounded sample of labelled rows (``sample_rows``); its lexicon
holds at most ``lexicon_size`` telling features, those most significant, and every clean word
of the sample that begins like one. Both are broadcast."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralens.llm.common import stage, texts

SAMPLE_ROWS = 200_000
LEXICON_SIZE = 50_000
PRIOR = 0.02                 # prior weight as a share of the counts
MIN_Z, MIN_TEXTS = 2.0, 3    # a telling feature: significance, toxic texts
E_VALUE = 0.05
LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (6, 5, 4)
KNOWN_WORDS = 1_000_000      # scores remembered in a Python worker


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)   # words as "=word", beginnings as they are
    drift: float = -0.01                                      # of any other token
    rate: float = 1.0                                         # lambda
    k: float = 0.1
    weights: tuple[float, float, float] = (-30.0, 0.0, 0.0)   # without toxic labels nothing is toxic

    def token(self, raw: str) -> float:
        """Score of a token between white space: the sum over its words of telling ones."""
        total, hit = 0.0, False
        for word in LETTERS.findall(raw.lower()):
            for f in ("=" + word, *(word[:n] for n in STEMS if len(word) >= n)):
                if f in self.lexicon:
                    total, hit = total + self.lexicon[f], True
                    break
        return total if hit else self.drift

    def normal(self, score: float, n: int) -> float:
        """-log of how often a clean text of n tokens has such a segment."""
        return self.rate * score - math.log(self.k * max(n, 1))

    def features(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        found = [max(0.0, self.normal(s, n) + math.log(E_VALUE)) for _, _, s in segments]
        return math.log1p(max(found, default=0.0)), math.log1p(sum(found))

    def probability(self, x: tuple[float, float]) -> float:
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x[0] + c * x[1]))))


class Scores(dict):
    """Scores by raw token, worked out once."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, raw: str) -> float:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[raw] = found = self.model.token(raw)
        return found


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: every positive
    run joins the segments before it as long as that raises the sum. Each segment points to
    the last one before it with a smaller sum at its start, so a search steps over a segment
    once: what it has passed is hidden behind the pointer of the segment it was for."""
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    out: list[tuple[int, int, float, float, int]] = []      # start, end, sum before, sum at the end, pointer
    for at, low, high in zip(hits.tolist(), total[hits].tolist(), total[hits + 1].tolist()):
        start, held = at, len(out) - 1
        while held >= 0 and out[held][2] >= low:
            held = out[held][4]
        while held >= 0 and out[held][3] < high:
            # joined from there on; what starts lower than the whole is behind its pointer
            start, _, low, _, before = out[held]
            del out[held:]
            held = before
        out.append((start, at + 1, low, high, held))
    return [(a, b, r - l) for a, b, l, r, _ in out]


def scan(model: Model, memo: Scores, text: str) -> tuple[int, list[tuple[int, int, float]]]:
    tokens = text.split()
    return len(tokens), segments(np.fromiter(map(memo.__getitem__, tokens), float, len(tokens)))


def labelled(labels: DataFrame, id_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """``id, y, fold``: about ``sample_rows`` labelled ids at most, chosen by hash. A null
    label is none; an id labelled twice has the larger label. Fold 0 calibrates."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    total = known.count()
    at = F.xxhash64("id")
    if total > sample_rows:
        known = known.where(F.pmod(at, F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    return known.withColumn("fold", F.pmod(F.shiftrightunsigned(at, 31), F.lit(4)).cast("int"))


def feature_counts(texts_: DataFrame) -> DataFrame:
    """``feature, toxic, clean``: in how many texts of either label a feature stands.
    Every task adds up its own before the shuffle."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["feature", "toxic", "clean"])
            counts.clear()
            return out

        for batch in batches:
            for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                words = set(LETTERS.findall(text.lower()))
                for f in {"=" + w for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n}:
                    counts.setdefault(f, [0, 0])[int(y > 0)] += 1
                if len(counts) > 300_000:
                    yield flush()
        yield flush()

    return texts_.select("text", "y").mapInArrow(run, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(toxic, clean, n_toxic: int, n_clean: int):
    """Log-odds ratio and its significance under the informative prior. A feature that all
    texts have is missing from half a text."""
    prior = F.lit(PRIOR) * (toxic + clean)
    size = PRIOR * (n_toxic + n_clean)
    odds = lambda has, n: F.log((has + prior) / F.greatest(n + size - has - prior, F.lit(0.5)))
    delta = odds(toxic, n_toxic) - odds(clean, n_clean)
    return delta, delta / F.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS, lexicon_size: int = LEXICON_SIZE) -> Model:
    """Learn from the texts of labelled ids. Without a toxic or a clean label, the model
    says 0 for all texts."""
    model = Model()
    sample = F.broadcast(labelled(labels, id_col, label_col, sample_rows))
    both = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    size = both.groupBy("fold", "y").count().collect()
    n = {y: sum(r["count"] for r in size if r["fold"] and (r["y"] > 0) == y) for y in (True, False)}
    if not n[True] or not n[False]:
        return model
    counts = stage(feature_counts(both.where("fold > 0")), "toxic-features")
    delta, z = log_odds(F.col("toxic"), F.col("clean"), n[True], n[False])
    scored = counts.select("*", delta.alias("delta"), z.alias("z"))
    telling = scored.where((F.col("z") >= MIN_Z) & (F.col("toxic") >= MIN_TEXTS) & (F.col("delta") >= 1.5))
    rows = telling.orderBy(F.desc("z"), "feature").limit(lexicon_size).collect()
    model.lexicon = {r["feature"]: float(r["delta"]) for r in rows}
    # words that only begin like telling ones, but are known to be clean
    begun = [(f,) for f in model.lexicon if f[0] != "="]
    if begun:
        stems = docs.sparkSession.createDataFrame(begun, "stem string")
        words = scored.where(F.col("feature").startswith("=") & (F.col("clean") >= 3) & (F.col("delta") < 1.0))
        own = words.select("feature", "delta", F.explode(F.array_distinct(F.array(*[F.col("feature").substr(2, n_) for n_ in STEMS]))).alias("stem"))
        for r in own.join(stems, "stem").select("feature", "delta").distinct().orderBy("feature").collect():
            model.lexicon.setdefault(r["feature"], min(float(r["delta"]), model.drift))
    calibrate(model, both.where("fold = 0"))
    return model


def calibrate(model: Model, fold: DataFrame) -> None:
    """Rate, K and logistic weights from texts the lexicon has not seen (at most the sample)."""

    def run(batches):
        memo = Scores(model)
        for batch in batches:
            ys, ns, tops, alls, dist = [], [], [], [], []
            for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                n, found = scan(model, memo, text)
                ys.append(int(y > 0)), ns.append(n), tops.append(max((s for *_, s in found), default=0.0)), alls.append([s for *_, s in found])
                dist.append([s for t in set(text.split()) if (s := memo[t]) > 0])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ns, pa.int64()), pa.array(tops, pa.float64()), pa.array(alls, pa.list_(pa.float64())), pa.array(dist, pa.list_(pa.float64()))], names=["y", "n", "top", "scores", "hits"])

    seen = stage(fold.select("text", "y").mapInArrow(run, "y int, n bigint, top double, scores array<double>, hits array<double>"), "toxic-calibration")
    clean = seen.where("y = 0")
    total = clean.agg(F.sum("n").alias("n")).first()["n"] or 1
    hits = [(r["s"], r["n"]) for r in clean.select(F.explode("hits").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()]
    # a hit that clean texts never had may still come: half a token in all
    hits.append((max(model.lexicon.values(), default=1.0), 0.5))
    mean = lambda r: sum(n * math.exp(r * s) for s, n in hits) / total + (1 - sum(n for _, n in hits) / total) * math.exp(r * model.drift) - 1
    low, high = 1e-6, 8.0
    if mean(high) > 0 > mean(low):
        for _ in range(60):
            low, high = ((low + high) / 2, high) if mean((low + high) / 2) < 0 else (low, (low + high) / 2)
        model.rate = low
    law = clean.where("n > 0").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n") * F.exp(-F.lit(model.rate) * F.col("top"))).alias("sum")).first()
    if law["texts"]:
        model.k = max(1e-6, law["texts"] / law["sum"])
    rows = seen.select("y", "n", "scores").collect()           # a part of the bounded sample
    x = np.array([[1.0, *model.features([(0, 0, s) for s in r["scores"]], r["n"])] for r in rows]).reshape(-1, 3)
    y = np.array([r["y"] for r in rows], float)
    if not len(y):
        model.weights = (-2.0, 2.0, 2.0)
        return
    # logistic regression by Newton steps, with a weak pull of the slopes to 1
    w, pull, centre = np.array([-2.0, 1.0, 1.0]), np.array([0.01, 0.1, 0.1]), np.array([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - centre))
        w = w + np.clip(step, -2, 2)
    model.weights = tuple(float(v) for v in w)


def apply(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False, drop: float | None = None) -> DataFrame:
    """All columns and ``tox_score, tox_segments`` (``start_token, end_token, e_value`` of
    significant segments, with ``spans``). ``drop``: leave out rows scored that high, and
    the new columns. Empty and null texts get the score of a text without hits. Columns of
    the input that have the names of new ones give way to them."""
    if drop is None:
        docs = docs.drop("tox_score", "tox_segments")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = "" if drop is not None else "tox_score double" + (", tox_segments array<struct<start_token:int,end_token:int,e_value:double>>" if spans else "")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), *([new] if new else [])])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        memo = Scores(m)
        for batch in batches:
            score, found = [], []
            for text in texts(batch.column(at)):
                n, got = scan(m, memo, text)
                score.append(m.probability(m.features(got, n)))
                if spans:
                    e = [(a, b, math.exp(-m.normal(s, n))) for a, b, s in got]
                    found.append([dict(start_token=a, end_token=b, e_value=v) for a, b, v in e if v < E_VALUE])
            if drop is not None:
                yield batch.filter(pa.array([s < drop for s in score], pa.bool_()))
                continue
            columns = [*batch.columns, pa.array(score, pa.float64())]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start_token", pa.int32()), ("end_token", pa.int32()), ("e_value", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "tox_score", "tox_segments"][: len(columns)])

    return docs.mapInArrow(run, schema)
