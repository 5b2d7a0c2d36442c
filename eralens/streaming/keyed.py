"""Keyed folds with saved state. Rows of a micro-batch are put in order per key; rows
at or before the last one seen are rejected. A task holds one key's rows of a micro-batch,
so the trigger's row limit bounds its memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from eralens.functions.lowrank import distances, effective_rank, fold_rows, leading_rows, mean_share, orthogonality_error, turnover


def _ordered(frames: Iterable[pd.DataFrame], order: str, after) -> pd.DataFrame:
    """New rows of a micro-batch in order."""
    rows = pd.concat(list(frames), ignore_index=True)
    return (rows if after is None else rows[rows[order] > after]).sort_values(order)


def _types(df: DataFrame, cols: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in cols)


def stream_lowrank_cov(stream: DataFrame, key: str, order: str, vector: str, rank: int = 8, decay: float = 0.99, size: int | None = None) -> DataFrame:
    """Decayed mean and covariance per key; emits the summary after every micro-batch. The state
    is the mean and a sketch of ``size`` rows (four times the rank unless given), not the whole
    covariance; ``error_bound`` is how far an eigenvalue can be below the true one."""
    size = size or 4 * rank

    def run(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mean, sketch, slack, seen, last = state.get if state.exists else (None, None, 0.0, 0, None)
        rows = _ordered(frames, order, last)
        if rows.empty:
            return
        x = np.array([np.asarray(v, dtype=np.float64) for v in rows[vector]])
        c, mean = distances(x, decay, None if mean is None else np.asarray(mean, dtype=np.float64))
        start = np.zeros((0, x.shape[1])) if sketch is None else np.asarray(sketch, dtype=np.float64).reshape(-1, x.shape[1])
        prior, off = fold_rows(start, slack, c[:-1], decay, size)
        now, slack = fold_rows(prior, off, c[-1:], decay, size)
        seen, last = seen + len(x), int(rows[order].iloc[-1])
        state.update((mean.tolist(), now.ravel().tolist(), slack, seen, last))
        basis, values = leading_rows(now, rank)
        yield pd.DataFrame({key: [name[0]], "rows": [seen], "eigenvalues": [values.tolist()], "effective_rank": [effective_rank(values)],
                            "turnover": [turnover(leading_rows(prior, rank)[0], basis)], "orthogonality_error": [orthogonality_error(basis)], "error_bound": [slack]})

    out = f"{_types(stream, [key])}, rows bigint, eigenvalues array<double>, effective_rank double, turnover double, orthogonality_error double, error_bound double"
    saved = "mean array<double>, sketch array<double>, slack double, seen bigint, last bigint"
    return stream.select(key, order, vector).groupBy(key).applyInPandasWithState(run, out, saved, "update", "NoTimeout")


def stream_ema(stream: DataFrame, key: str, order: str, value: str, decay: float = 0.98) -> DataFrame:
    """Exponential average per key, started with the first value. A micro-batch adds the
    decayed sum of its rows to the faded average."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, seen, last = state.get if state.exists else (None, 0, None)
        rows = _ordered(frames, order, last)
        if rows.empty:
            return
        added = float(mean_share(rows[value].to_numpy(np.float64)[:, None], decay, level is None)[0])
        level = added if level is None else decay ** len(rows) * level + added
        seen, last = seen + len(rows), int(rows[order].iloc[-1])
        state.update((level, seen, last))
        yield pd.DataFrame({key: [name[0]], "ema": [level], "rows": [seen]})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(
        run, f"{_types(stream, [key])}, ema double, rows bigint", "level double, seen bigint, last bigint", "update", "NoTimeout")


def stream_drawdown_monitor(stream: DataFrame, key: str, era: str, value: str, alert: float) -> DataFrame:
    """Running total, peak and drawdown per model and era, with an alert flag. An era not
    after the last one seen comes out as rejected. One row per era and model."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, peak, last = state.get if state.exists else (0.0, None, None)
        rows, out = pd.concat(list(frames), ignore_index=True).sort_values(era), []
        for e, x in zip(rows[era], rows[value]):
            if last is not None and e <= last:
                out.append((name[0], int(e), None, None, None, False, True))
                continue
            total, last = total + float(x), int(e)
            peak = total if peak is None else max(peak, total)
            out.append((name[0], last, total, peak, peak - total, peak - total > alert, False))
        state.update((total, peak, last))
        yield pd.DataFrame(out, columns=[key, era, "cumulative", "peak", "drawdown", "alert", "rejected"])

    return stream.select(key, era, value).groupBy(key).applyInPandasWithState(
        run, f"{_types(stream, [key, era])}, cumulative double, peak double, drawdown double, alert boolean, rejected boolean",
        "total double, peak double, last bigint", "append", "NoTimeout")
