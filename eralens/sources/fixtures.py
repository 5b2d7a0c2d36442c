"""The evaluation tables derived from the given parquet tables.

``panel``       one row per order: id, era (month 1..80), six feature codes, targets
                (NULL while unresolved), benchmarks (NULL before they start)
``pred``        panel rows x 2 arms x 3 seeds with a prediction
``cells``       score table: one row per (arm, config_id, split, updates, seed)
``logs``        training-log like series: one row per (run, update)
``era_scores``  corr and bmc per (arm, seed, era), computed from ``pred``
All noise is hashed from keys, so any engine gets the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralens.functions.exprs import AS241_CENTRE, AS241_FAR, AS241_MIDDLE, hash_unit, keyed, ratio_text
from eralens.functions.ranking import plan_groups
from eralens.session import cut_lineage, scan_bytes, shuffles_of
from eralens.sources.tables import read_spread

ERA_SQL = "CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT)"
BENCHMARK_FROM = 12      # first era with benchmark predictions
RESOLVED_UNTIL = 76      # later eras have no target yet
TRAIN_UNTIL = 40
ARMS = ("filtered", "plain")
SEEDS = (0, 1, 2)
FILE_ROWS = 62_500       # of a stored file; a scan takes some 30 files a task, as each counts as 4 MB at least
JOIN_ROWS = 250_000      # of the largest given table that a task of the panel's joins gets
JOIN_BYTES = 4 << 20     # of their shuffles
SCAN_BYTES = 16 << 20    # of the given tables that a task reads
BUDGETS = (5000, 20000, 100000)
FEATURES = ("price", "quantity", "discount", "tax", "lines", "balance")


def code(expr: str) -> str:
    """0..4 bin of a non-negative scaled expression (same text in both engines)."""
    return f"CAST(least(4e0, greatest(0e0, floor({expr}))) AS INT)"


CODES = {
    "price": code("o_totalprice / 100000e0"),
    "quantity": code("coalesce(qty, 102e0) / 50e0"),
    "discount": code("coalesce(disc * 0.5e0 / n_lines, 2.5e0)"),
    "tax": code("coalesce(tax * 0.625e0 / n_lines, 2.5e0)"),
    "lines": code("coalesce(n_lines, 4) / 2e0"),
    "balance": code("(c_acctbal + 1000e0) / 2200e0"),
}


STORED: dict = {}


class Tables:
    """Lazy access to the given tables and the frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return read_spread(self.spark, self.path(name))

    def eras(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.expr(ERA_SQL).alias("era"))

    def plan(self, times: int = len(ARMS) * len(SEEDS)):
        """Window or range plan for era groups, counted once on the order table; ``times`` is how
        many rows a frame has for each order, by default as many as the predictions."""
        return self._once(f"plan-{times}", lambda: plan_groups(self.eras(), ["era"], times=times))

    def _once(self, name: str, build):
        slot = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if slot not in STORED:
            STORED[slot] = build()
        return STORED[slot]

    def panel(self) -> DataFrame:
        """The panel as a stored table, built once per application."""
        def build() -> DataFrame:
            rows = max(self.table(name).count() for name in ("lineitem", "orders", "customer"))
            with scan_bytes(self.spark, SCAN_BYTES), shuffles_of(self.spark, rows, JOIN_ROWS, JOIN_BYTES):
                return cut_lineage(self.build_panel(), "panel", FILE_ROWS)

        return self._once("panel", build)

    def pred(self) -> DataFrame:
        """The predictions as a stored table, built once per application."""
        return self._once("pred", lambda: cut_lineage(self.build_pred(), "pred", FILE_ROWS))

    def build_panel(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_orderkey").agg(
            F.sum("l_quantity").alias("qty"),
            F.sum(F.rint(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
            F.sum(F.rint(F.col("l_tax") * 100).cast("bigint")).alias("tax"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        customers = self.table("customer").select("c_custkey", "c_acctbal")
        base = (
            self.table("orders")
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select(
                F.col("o_orderkey").alias("id"),
                F.expr(ERA_SQL).alias("era"),
                "o_totalprice", "c_acctbal",
                *[F.expr(sql).alias(f"code_{name}") for name, sql in CODES.items()],
            )
        )
        u = hash_unit(keyed("t", F.col("id")))
        lift = (F.col("code_price") + F.col("code_quantity") + F.col("code_discount") + F.col("code_balance")) / F.lit(16.0)
        latent = F.lit(0.6) * u + F.lit(0.4) * lift
        second = F.lit(0.5) * hash_unit(keyed("u", F.col("id"))) + F.lit(0.5) * F.col("latent")
        resolved, covered = F.col("era") <= RESOLVED_UNTIL, F.col("era") >= BENCHMARK_FROM

        def bin5(x):
            return F.least(F.lit(4.0), F.floor(x * F.lit(5.0)).cast("double")) / F.lit(4.0)

        return (
            base.withColumn("latent", latent)
            .select(
                "id", "era",
                F.when(F.col("era") <= TRAIN_UNTIL, "train")
                .when(resolved, "validation").otherwise("live").alias("data_type"),
                F.array(*[F.col(f"code_{n}") for n in FEATURES]).alias("features"),
                F.when(resolved, bin5(F.col("latent"))).alias("target"),
                F.when(resolved, bin5(second)).alias("target_b"),
                F.when(covered, F.col("c_acctbal")).alias("benchmark"),
                F.when(covered, F.col("o_totalprice")).alias("benchmark_b"),
                "latent",
            )
        )

    def scored_eras(self, least: int = 5) -> DataFrame:
        """Resolved eras with at least ``least`` rows."""
        return (
            self.eras().where(F.col("era") <= RESOLVED_UNTIL).groupBy("era")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("era")
        )

    def build_pred(self) -> DataFrame:
        rows = self.panel().where(F.col("target").isNotNull()).join(self.scored_eras(), "era", "left_semi")
        models = F.explode(F.array(*[
            F.struct(F.lit(a).alias("arm"), F.lit(s).alias("seed"), F.lit(w).alias("signal"))
            for a, w in (("filtered", 0.12), ("plain", 0.10)) for s in SEEDS
        ]))
        raw = F.col("m.signal") * F.col("latent") + hash_unit(keyed(F.col("m.arm"), F.col("m.seed"), F.col("id")))
        return rows.select("id", "era", "target", "target_b", "benchmark", "benchmark_b", "latent", models.alias("m")).select(
            "id", "era", F.col("m.arm").alias("arm"), F.col("m.seed").alias("seed"),
            "target", "target_b", "benchmark", "benchmark_b",
            (F.floor(raw * 1000.0) / 1000.0).alias("prediction"),
        )

    def cells(self) -> DataFrame:
        """The score table, stored once per application."""
        return self._once("cells", lambda: cut_lineage(self.build_cells(), "cells"))

    def build_cells(self) -> DataFrame:
        """Score cells from line items: a supplier is a config, its lines are runs."""
        return (
            self.table("lineitem")
            .select(
                F.when(F.col("l_linestatus") == "F", "filtered").otherwise("plain").alias("arm"),
                F.col("l_suppkey").cast("int").alias("config_id"),
                F.when(F.col("l_returnflag") == "A", "fold_1").when(F.col("l_returnflag") == "N", "fold_2")
                .otherwise("fold_3").alias("split"),
                F.when(F.col("l_linenumber") <= 2, 5000).when(F.col("l_linenumber") <= 4, 20000)
                .otherwise(100000).alias("updates"),
                F.when(F.col("l_quantity") <= 17, 0).when(F.col("l_quantity") <= 34, 1).otherwise(2).alias("seed"),
                F.rint(F.col("l_discount") * 100).cast("bigint").alias("d"),
                F.rint(F.col("l_tax") * 100).cast("bigint").alias("t"),
            )
            .groupBy("arm", "config_id", "split", "updates", "seed")
            .agg(F.sum("d").alias("d"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("runs"))
            .select(
                "arm", "config_id", "split", "updates", "seed",
                (F.col("d") / F.col("runs") / 100.0 - 0.05).alias("corr_mean"),
                (F.col("t") / F.col("runs") / 100.0 - 0.04).alias("bmc_mean"),
                F.col("runs").cast("bigint").alias("runs"),
            )
        )

    def logs(self) -> DataFrame:
        """Loss series: run = user, update = position of the event id, loss > 0."""
        e = self.table("events")
        return e.select(
            F.when(F.col("event_type").isin("click", "view"), "filtered").otherwise("plain").alias("arm"),
            F.col("event_type").alias("kind"), F.col("user_id").alias("run"),
            F.col("event_id").alias("update"),
            F.dayofmonth("ts").cast("int").alias("step"),
            (F.col("value") + 1.0).alias("loss"),
        )

    def era_scores(self) -> DataFrame:
        """Scores per model and era, stored once like a stage file."""
        from eralens.operators import score

        return self._once("era_scores", lambda: cut_lineage(
            score.bmc_covered_only(self.pred(), ["arm", "seed", "era"], plan=self.plan()), "era-scores"))


# ---- the same frames as SQL text for the comparison engine -------------------------

def H(text: str) -> str:
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296e0)"


def _bin5(x: str) -> str:
    return f"least(4e0, floor(({x}) * 5e0)) / 4e0"


PANEL = f"""
lines AS (SELECT l_orderkey, sum(l_quantity) AS qty, CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS disc,
  CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS tax, count(*) AS n_lines FROM lineitem GROUP BY 1),
panel0 AS (SELECT o_orderkey AS id, {ERA_SQL} AS era, o_totalprice, c_acctbal,
  {", ".join(f"{sql} AS code_{n}" for n, sql in CODES.items())}
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey),
panel1 AS (SELECT *, 0.6e0*{H("'t:' || id")} + 0.4e0*((code_price+code_quantity+code_discount+code_balance)/16e0) AS latent FROM panel0),
panel AS (SELECT id, era, CASE WHEN era <= {TRAIN_UNTIL} THEN 'train' WHEN era <= {RESOLVED_UNTIL} THEN 'validation' ELSE 'live' END AS data_type,
  [{", ".join("code_" + n for n in FEATURES)}] AS features,
  CASE WHEN era <= {RESOLVED_UNTIL} THEN {_bin5("latent")} END AS target,
  CASE WHEN era <= {RESOLVED_UNTIL} THEN {_bin5("0.5e0*" + H("'u:' || id") + " + 0.5e0*latent")} END AS target_b,
  CASE WHEN era >= {BENCHMARK_FROM} THEN c_acctbal END AS benchmark,
  CASE WHEN era >= {BENCHMARK_FROM} THEN o_totalprice END AS benchmark_b, latent FROM panel1)"""

PRED = PANEL + f""",
scored AS (SELECT era FROM panel WHERE target IS NOT NULL GROUP BY era HAVING count(*) >= 5),
models AS (SELECT * FROM (VALUES ('filtered',0,0.12e0),('filtered',1,0.12e0),('filtered',2,0.12e0),('plain',0,0.10e0),('plain',1,0.10e0),('plain',2,0.10e0)) m(arm, seed, signal)),
pred AS (SELECT id, era, arm, seed, target, target_b, benchmark, benchmark_b,
  floor((signal*latent + {H("arm || ':' || seed || ':' || id")}) * 1000e0) / 1000e0 AS prediction
  FROM panel CROSS JOIN models WHERE target IS NOT NULL AND era IN (SELECT era FROM scored))"""

CELLS = """
cells AS (SELECT arm, config_id, split, updates, seed, CAST(sum(d) AS BIGINT)/CAST(count(*) AS DOUBLE)/100e0 - 0.05e0 AS corr_mean,
  CAST(sum(t) AS BIGINT)/CAST(count(*) AS DOUBLE)/100e0 - 0.04e0 AS bmc_mean, count(*) AS runs
  FROM (SELECT CASE WHEN l_linestatus='F' THEN 'filtered' ELSE 'plain' END AS arm, CAST(l_suppkey AS INT) AS config_id,
    CASE WHEN l_returnflag='A' THEN 'fold_1' WHEN l_returnflag='N' THEN 'fold_2' ELSE 'fold_3' END AS split,
    CASE WHEN l_linenumber<=2 THEN 5000 WHEN l_linenumber<=4 THEN 20000 ELSE 100000 END AS updates,
    CASE WHEN l_quantity<=17 THEN 0 WHEN l_quantity<=34 THEN 1 ELSE 2 END AS seed,
    CAST(round(l_discount*100) AS BIGINT) AS d, CAST(round(l_tax*100) AS BIGINT) AS t FROM lineitem)
  GROUP BY 1,2,3,4,5)"""

LOGS = """
logs AS (SELECT CASE WHEN event_type IN ('click','view') THEN 'filtered' ELSE 'plain' END AS arm, event_type AS kind, user_id AS run,
  event_id AS "update", CAST(day(ts) AS INT) AS step, value + 1e0 AS loss FROM events)"""


def probit_sql(p: str) -> str:
    """Inverse normal as SQL text over a column name."""
    q, r = f"({p}-0.5e0)", f"sqrt(-ln(least({p}, 1e0-{p})))"
    return (
        f"CASE WHEN {p}<=0 OR {p}>=1 THEN NULL "
        f"WHEN abs{q}<=0.425e0 THEN {q}*{ratio_text(AS241_CENTRE, f'(0.180625e0-{q}*{q})')} "
        f"WHEN {r}<=5e0 THEN sign{q}*{ratio_text(AS241_MIDDLE, f'({r}-1.6e0)')} "
        f"ELSE sign{q}*{ratio_text(AS241_FAR, f'({r}-5e0)')} END"
    )


def avg_rank_sql(value: str, keys: str) -> str:
    return (f"((rank() OVER (PARTITION BY {keys} ORDER BY {value}) - 1) + "
            f"count(*) OVER (PARTITION BY {keys}, {value})/2e0) / count(*) OVER (PARTITION BY {keys})")


def spow(x: str) -> str:
    return f"(sign({x})*pow(abs({x}), 1.5e0))"


def official_sql(source: str, keys: str, pred: str = "prediction", target: str = "target", tag: str = "o") -> str:
    """CTEs ending in {tag}_corr(keys, corr)."""
    return f"""
{tag}_r AS (SELECT {keys}, {avg_rank_sql(pred, keys)} AS r, {target} - avg({target}) OVER (PARTITION BY {keys}) AS tc FROM {source}),
{tag}_g AS (SELECT {keys}, {probit_sql("r")} AS g, tc FROM {tag}_r),
{tag}_corr AS (SELECT {keys}, CASE WHEN stddev_pop(g) > 1e-12 AND stddev_pop(tc) > 1e-12 THEN corr({spow("g")}, {spow("tc")}) END AS corr FROM {tag}_g GROUP BY {keys})"""


def bmc_sql(source: str, keys: str, pred: str = "prediction", bench: str = "benchmark", target: str = "target", tag: str = "b") -> str:
    """CTEs ending in {tag}_bmc(keys, bmc); rows without a benchmark are left out."""
    return f"""
{tag}_s AS (SELECT * FROM {source} WHERE {bench} IS NOT NULL),
{tag}_r AS (SELECT {keys}, {avg_rank_sql(pred, keys)} AS rp, {avg_rank_sql(bench, keys)} AS rm,
  CASE WHEN min({target}) OVER (PARTITION BY {keys}) >= 0 AND max({target}) OVER (PARTITION BY {keys}) <= 1 THEN 4e0 ELSE 1e0 END
   * ({target} - avg({target}) OVER (PARTITION BY {keys})) AS t FROM {tag}_s),
{tag}_g AS (SELECT {keys}, {probit_sql("rp")} AS p, {probit_sql("rm")} AS m, t FROM {tag}_r),
{tag}_bmc AS (SELECT {keys}, (sum(t*p) - CASE WHEN sum(m*m) > 1e-12 THEN sum(p*m)/sum(m*m)*sum(t*m) ELSE 0e0 END)/count(*) AS bmc FROM {tag}_g GROUP BY {keys})"""


ERA_SCORES = PRED + "," + official_sql("pred", "arm, seed, era", tag="eo") + "," + bmc_sql("pred", "arm, seed, era", tag="eb") + """,
era_scores AS (SELECT arm, seed, era, corr, bmc FROM eo_corr LEFT JOIN eb_bmc USING (arm, seed, era))"""
