"""Structured Streaming over the given tables; the SQL is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from eralens.functions.exprs import moments_corr, rounded
from eralens.plans.registry import query, with_
from eralens.session import scratch
from eralens.sources.fixtures import ERA_SCORES, H, avg_rank_sql
from eralens.streaming import keyed, rounds
from eralens.streaming.arrivals import require_none_dropped
from eralens.streaming.sink import latest, replay, run_available, stored, write_batches

CHUNKS = 3


def rr(*cols, digits=8):
    return [rounded(F.col(c), digits).alias(c) for c in cols]


def events(t, *extra):
    """Events with their round (day of month) and a chunk of ten days each."""
    e = t.table("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("round", F.dayofmonth("ts"))
    return e.withColumn("chunk", F.least(F.lit(CHUNKS - 1), F.floor((F.col("round") - 1) / 10)).cast("int"))


def arrive(sources, build, out, mode="append", transform=None):
    """The sources arrive in three steps; the query resumes after each."""
    replay(sources, "chunk", CHUNKS, lambda s, _last: run_available(build(**s), write_batches(f"{out}/rows", transform), f"{out}/checkpoint", mode))


def by_arrival(df, days: int):
    """Rows with the ``chunk`` in which they arrive: so many days each, in order."""
    start = F.unix_seconds(F.lit("1970-01-01").cast("timestamp"))
    return df.withColumn("chunk", F.floor((F.unix_seconds("arrived") - start) / (86400 * days)).cast("int"))


def chunks_of(df):
    """Chunk numbers from 0, and how many there are."""
    low, high = df.agg(F.min("chunk"), F.max("chunk")).first()
    return df.withColumn("chunk", F.col("chunk") - low), high - low + 1


# a round is a day and closes two days after it; some rows take four days, some come twice
ARRIVALS = f"""e AS (SELECT event_id AS id, CAST(day(ts) AS INT) AS round, value AS m1, {H("'m2:' || event_id")} AS m2, user_id * 1e0 AS bench,
 ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL 4 DAYS ELSE INTERVAL 1 MINUTE END AS arrived, date_trunc('day', ts) + INTERVAL 3 DAYS AS closes FROM events),
a AS (SELECT * FROM e UNION ALL SELECT * REPLACE (arrived + INTERVAL 2 HOURS AS arrived) FROM e WHERE event_id_twice),
k AS (SELECT round, id, count(*) FILTER (arrived < closes) AS good, count(*) FILTER (arrived >= closes) AS late, any_value(m1) AS m1, any_value(m2) AS m2, any_value(bench) AS bench,
 any_value(closes) <= (SELECT max(arrived) FROM a) AS closed FROM a GROUP BY round, id),
r AS (SELECT id, round, {avg_rank_sql('m1', 'round')} AS a, {avg_rank_sql('m2', 'round')} AS b, {avg_rank_sql('bench', 'round')} AS c FROM k WHERE closed AND good > 0),
x AS (SELECT id, round, round(0.5e0*(a + b)/2e0 + 0.5e0*c, 12) AS mix FROM r)""".replace("event_id_twice", "id % 40 = 1")


def arriving(t):
    from eralens.functions.exprs import hash_unit
    from eralens.functions.exprs import keyed as text

    e = t.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    delay = F.when(F.col("event_id") % 50 == 0, F.expr("INTERVAL 4 DAYS")).otherwise(F.expr("INTERVAL 1 MINUTE"))
    d = e.select(
        F.col("event_id").alias("id"), F.dayofmonth("ts").alias("round"), F.col("value").alias("m1"), hash_unit(text("m2", F.col("event_id"))).alias("m2"),
        F.col("user_id").cast("double").alias("bench"), (F.col("ts") + delay).alias("arrived"), (F.date_trunc("day", "ts") + F.expr("INTERVAL 3 DAYS")).alias("closes"))
    return d.unionByName(d.where("id % 40 = 1").withColumn("arrived", F.col("arrived") + F.expr("INTERVAL 2 HOURS")))


def scored_rounds(t, days):
    d, n = chunks_of(by_arrival(arriving(t), days))
    out = scratch(t.spark, "scored")
    replay({"live": d}, "chunk", n, lambda s, _: rounds.score_rounds(s["live"], out, f"{out}/checkpoint", ["m1", "m2"], "bench", "arrived", "closes"))
    got = stored(t.spark, f"{out}/scores", "round int, id bigint, prediction double")
    aside = stored(t.spark, f"{out}/sorted", "id bigint, round int, kind string").where("kind <> 'closed'")
    return got.select("round", "id", F.lit("scored").alias("kind"), *rr("prediction")).unionByName(
        aside.select("round", "id", "kind", F.lit(None).cast("double").alias("prediction")))


@query("stream_score_rounds", with_(ARRIVALS, f"""SELECT round, id, 'scored' AS kind, round({avg_rank_sql('mix', 'round')}, 8) AS prediction FROM x
UNION ALL SELECT round, id, 'late', NULL FROM a WHERE arrived >= closes
UNION ALL SELECT round, id, 'repeated', NULL FROM (SELECT round, id, unnest(range(good - 1)) FROM k WHERE good > 1)"""))
def _(t):
    """Rows of all rounds closed by the end of the input, with late and repeated ones."""
    return scored_rounds(t, 12)


@query("stream_label_join", """WITH p AS (SELECT event_id, CAST(day(ts) AS INT) AS round, value, ts FROM events)
SELECT round, count(*) AS rows, count(*) FILTER (WHERE event_type <> 'signup') AS matched, round(avg(CASE WHEN event_type <> 'signup' THEN (value - user_id) * (value - user_id) END), 6) AS mse,
 count(*) FILTER (WHERE event_type = 'signup') > 0 AS provisional FROM (SELECT CAST(day(ts) AS INT) AS round, event_type, value, user_id FROM events) GROUP BY round""")
def _(t):
    e = events(t)
    preds = e.select(F.col("event_id").alias("id"), "round", "ts", F.col("value").alias("prediction"), "chunk")
    # a label arrives three days later; signups never resolve
    labels = e.where("event_type <> 'signup'").select(
        F.col("event_id").alias("id"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("label_ts"), F.col("user_id").cast("double").alias("label"), "chunk")
    out = scratch(t.spark, "joined")
    arrive({"preds": preds, "labels": labels}, lambda preds, labels: rounds.label_join(preds, labels, "4 DAYS", "12 days"), out)
    rows = stored(t.spark, f"{out}/rows", "id bigint, round int, ts timestamp, prediction double, label_ts timestamp, label double")
    expected = e.groupBy("round").agg(F.count(F.lit(1)).alias("rows"))
    return rounds.matched_scores(rows, expected).select("round", "rows", "matched", *rr("mse", digits=6), "provisional")


@query("stream_lowrank_cov")
def _(t):
    d = t.table("embeddings").select("label", "vec_id", "embedding")
    last = t.table("embeddings").agg(F.max("vec_id")).first()[0]
    d = d.withColumn("chunk", F.least(F.lit(CHUNKS - 1), F.floor(F.col("vec_id") * CHUNKS / (last + 1))).cast("int"))
    out = scratch(t.spark, "lowrank")
    arrive({"vectors": d}, lambda vectors: keyed.stream_lowrank_cov(vectors, "label", "vec_id", "embedding"), out, "update")
    rows = stored(t.spark, f"{out}/rows", "label int, rows bigint, eigenvalues array<double>, effective_rank double, turnover double, orthogonality_error double, error_bound double")
    return latest(rows, ["label"], ["rows", "eigenvalues", "effective_rank", "turnover", "orthogonality_error", "error_bound"])


@query("stream_era_moments", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n, round(corr(value, user_id), 8) + 0e0 AS corr, round(avg((value - user_id) * (value - user_id)), 6) AS mse FROM events GROUP BY 1""")
def _(t):
    d = events(t).select("ts", "value", F.col("user_id").cast("double").alias("label"), "chunk")
    out = scratch(t.spark, "moments")
    arrive({"live": d}, lambda live: rounds.era_moments(live, "ts", "value", "label"), out, "update")
    names = ["n", "sx", "sy", "sxx", "syy", "sxy", "sse"]
    rows = stored(t.spark, f"{out}/rows", "start timestamp, n bigint, sx double, sy double, sxx double, syy double, sxy double, sse double")
    d = latest(rows, ["start"], names)
    c = F.col
    corr = moments_corr(c("n"), c("sx"), c("sy"), c("sxx"), c("syy"), c("sxy"))
    return d.select(c("start").cast("timestamp_ntz").alias("start"), "n", rounded(corr).alias("corr"), rounded(c("sse") / c("n"), 6).alias("mse"))


@query("stream_ema", """WITH RECURSIVE p AS (SELECT user_id AS run, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
e AS (SELECT run, k, n, x AS ema FROM p WHERE k = 1 UNION ALL SELECT p.run, p.k, p.n, 0.98e0*e.ema + 0.02e0*p.x FROM e JOIN p ON p.run = e.run AND p.k = e.k + 1)
SELECT run, round(ema, 7) AS ema, n AS rows FROM e WHERE k = n""")
def _(t):
    d = events(t).select(F.col("user_id").alias("run"), "event_id", "value", "chunk")
    out = scratch(t.spark, "ema")
    arrive({"losses": d}, lambda losses: keyed.stream_ema(losses, "run", "event_id", "value"), out, "update")
    rows = stored(t.spark, f"{out}/rows", "run bigint, ema double, rows bigint")
    return latest(rows, ["run"], ["ema", "rows"]).select("run", *rr("ema", digits=7), "rows")


@query("stream_drawdown_monitor", with_(ERA_SCORES + """,
c AS (SELECT arm || '_s' || seed AS model, era, sum(corr) OVER (PARTITION BY arm, seed ORDER BY era) AS cumulative FROM era_scores WHERE corr IS NOT NULL), p AS (SELECT *, max(cumulative) OVER (PARTITION BY model ORDER BY era) AS peak FROM c)""",
    "SELECT model, era, round(cumulative, 8) + 0e0 AS cumulative, round(peak, 8) + 0e0 AS peak, round(peak - cumulative, 8) + 0e0 AS drawdown, peak - cumulative > 0.2e0 AS alert, false AS rejected FROM p"))
def _(t):
    s = t.era_scores().where(F.col("corr").isNotNull())
    d = s.select(F.concat("arm", F.lit("_s"), F.col("seed").cast("string")).alias("model"), "era", "corr", F.least(F.lit(CHUNKS - 1), F.floor(F.col("era") / 27)).cast("int").alias("chunk"))
    out = scratch(t.spark, "drawdown")
    arrive({"scores": d}, lambda scores: keyed.stream_drawdown_monitor(scores, "model", "era", "corr", 0.2), out)
    rows = stored(t.spark, f"{out}/rows", "model string, era int, cumulative double, peak double, drawdown double, alert boolean, rejected boolean")
    return rows.select("model", "era", *rr("cumulative", "peak", "drawdown"), "alert", "rejected")


SHIP = "CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT)"


@query("stream_dedup_ids", f"""WITH a AS (SELECT {SHIP} AS round, l_orderkey, l_linenumber, l_shipdate + to_days(CAST(l_partkey % 60 AS INT)) AS arrived, date_trunc('month', l_shipdate) + INTERVAL 60 DAYS AS closes FROM lineitem),
k AS (SELECT round, l_orderkey, l_linenumber, count(*) FILTER (arrived < closes) AS good, count(*) FILTER (arrived >= closes) AS late FROM a GROUP BY ALL)
SELECT round, count(*) FILTER (good > 0) AS first, CAST(sum(greatest(good - 1, 0)) AS BIGINT) AS repeated, CAST(sum(late) AS BIGINT) AS late, CAST(sum(good + late) AS BIGINT) AS arrived FROM k GROUP BY round""")
def _(t):
    """A round is a month and closes 60 days after it began; rows arrive up to 59 days late."""
    li = t.table("lineitem").select(
        F.expr(SHIP).alias("round"), "l_orderkey", "l_linenumber", (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(F.col("l_partkey") % 60)).alias("arrived"),
        (F.date_trunc("month", F.col("l_shipdate").cast("timestamp")) + F.expr("INTERVAL 60 DAYS")).alias("closes"))
    d, n = chunks_of(by_arrival(li, 900))
    out = scratch(t.spark, "dedup")
    build = lambda lines: rounds.dedup_ids(lines, "round", ["l_orderkey", "l_linenumber"], "arrived", "closes").select("round", "kind")
    replay({"lines": d}, "chunk", n, lambda s, _: require_none_dropped(run_available(build(**s), write_batches(f"{out}/rows"), f"{out}/checkpoint")))
    rows = stored(t.spark, f"{out}/rows", "round int, kind string")
    return rows.groupBy("round").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("first", "repeated", "late")], F.count(F.lit(1)).alias("arrived"))


@query("stream_round_constancy", """WITH b AS (SELECT least(2, (CAST(day(ts) AS INT) - 1) // 10) AS batch_id, min(CAST(day(ts) AS INT)) AS first_round, max(CAST(day(ts) AS INT)) AS last_round, count(*) AS rows FROM events GROUP BY 1)
SELECT *, first_round = last_round AS constant, lag(last_round) OVER (ORDER BY batch_id) AS before, coalesce(first_round <> lag(last_round) OVER (ORDER BY batch_id), false) AS changed FROM b""")
def _(t):
    d = events(t).select("round", "event_id", "chunk")
    out = scratch(t.spark, "constancy")
    replay({"live": d}, "chunk", CHUNKS, lambda s, _: rounds.round_constancy(s["live"], out, f"{out}/checkpoint"))
    return stored(t.spark, f"{out}/rounds", "first_round int, last_round int, rows bigint, constant boolean, before int, changed boolean").select(
        "batch_id", "first_round", "last_round", "rows", "constant", "before", "changed")
