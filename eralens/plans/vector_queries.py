"""Vector statistics, model scoring and training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eralens.functions.exprs import rounded
from eralens.functions.lowrank import rank_by_rule
from eralens.functions.ranking import plan_groups
from eralens.operators import models, vectors
from eralens.plans.registry import query, with_
from eralens.sources.fixtures import FEATURES, LOGS, PANEL

DIM = 64
P = len(FEATURES)
V = ("label", "embedding", DIM)


def rr(*cols, digits=8):
    return [rounded(F.col(c), digits).alias(c) for c in cols]


def hu(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def emb(t):
    return t.table("embeddings")


@query("group_gram_spectrum")
def _(t):
    s = vectors.group_gram_spectrum(emb(t), *V)
    return s.select("label", "n", F.posexplode("eigenvalues").alias("k", "eigenvalue"))


@query("spectrum_invariants", f"""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x*x))) AS len FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT label, vec_id, unnest(e)/len AS v, unnest(range({DIM})) AS i FROM e), n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
uu AS (SELECT a.label, a.i, b.i AS j, sum(a.v*b.v) AS p FROM u a JOIN u b USING (label, vec_id) GROUP BY 1, 2, 3)
SELECT label, n, round(sum(CASE WHEN i = j THEN p ELSE 0e0 END), 6) AS trace, round(sum(p*p)/(n*n), 8) AS squared_share FROM uu JOIN n USING (label) GROUP BY label, n""")
def _(t):
    """Sum and sum of squares of each group's eigenvalues; the SQL has both without an eigenproblem."""
    s = vectors.group_gram_spectrum(emb(t), *V)
    fold = lambda e: F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + e(x))
    return s.select("label", "n", rounded(fold(lambda x: x), 6).alias("trace"), rounded(fold(lambda x: x * x) / (F.col("n") * F.col("n")), 8).alias("squared_share"))


def _consensus(name, mode):
    @query(name)
    def _(t):
        return vectors.consensus_filter(emb(t), *V, mode=mode)


for _name, _mode in (("consensus_filter", "hard"), ("consensus_filter_soft", "soft"), ("consensus_filter_variance", "variance")):
    _consensus(_name, _mode)


@query("kept_energy")
def _(t):
    return vectors.kept_energy(vectors.group_gram_spectrum(emb(t), *V), "label")


@query("spectrum_stats")
def _(t):
    return vectors.spectrum_stats(vectors.group_gram_spectrum(emb(t), *V), "label")


@query("sign_agreement_mask", """WITH e AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
s AS (SELECT label, CAST(pos AS INT) AS pos, sum(sign(v)) AS signs, avg(CAST(v AS DOUBLE)) AS mean, count(*) AS n FROM e GROUP BY 1, 2)
SELECT label, pos, round(CASE WHEN abs(signs) >= 2e0*sqrt(n) THEN mean ELSE 0e0 END, 8) + 0e0 AS masked_mean, abs(signs) >= 2e0*sqrt(n) AS kept FROM s""")
def _(t):
    return vectors.sign_agreement_mask(emb(t), "label", "embedding").select("label", "pos", *rr("masked_mean"), "kept")


@query("random_subspace_control")
def _(t):
    return vectors.random_subspace_control(emb(t), "label", "embedding", "vec_id", DIM, 8, 0.5, 3)


@query("group_mean_cosine", f"""WITH e AS (SELECT label, {hu("'0:' || vec_id")} % 2 AS half, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
o AS (SELECT label, pos, sum(CASE WHEN half = 0 THEN CAST(v AS DOUBLE) END) AS a, sum(CASE WHEN half = 1 THEN CAST(v AS DOUBLE) END) AS b FROM e GROUP BY 1, 2),
d AS (SELECT *, sum(b) OVER (PARTITION BY pos) - coalesce(b, 0e0) AS o FROM o)
SELECT label, round(sum(a*b)/sqrt(sum(a*a)*sum(b*b)), 8) + 0e0 AS same_group, round(sum(a*o)/sqrt(sum(a*a)*sum(o*o)), 8) + 0e0 AS other_groups FROM d GROUP BY label""")
def _(t):
    return vectors.group_mean_cosine(emb(t), "label", "embedding", "vec_id").select("label", *rr("same_group", "other_groups"))


def fold_plan(t):
    return plan_groups(emb(t), ["label"])


@query("streaming_lowrank_cov")
def _(t):
    return vectors.streaming_lowrank_cov(emb(t), "label", "vec_id", "embedding", rank=8, plan=fold_plan(t))


def global_basis(t, rank=8):
    """Leading eigenvectors of the table's covariance (dim x dim numbers on the driver)."""
    c = vectors.distributed_covariance(emb(t), "embedding", DIM).toPandas()
    m = np.zeros((DIM, DIM))
    m[c["i"], c["j"]] = c["covariance"]
    lam, vec = np.linalg.eigh((m + m.T) / 2)
    return vec[:, ::-1][:, :rank], lam[::-1][:rank]


@query("lowrank_project")
def _(t):
    basis, _ = global_basis(t)
    d = emb(t).select("vec_id", "embedding")
    for mode in ("top", "remove", "remove_renorm", "norm_matched", "random"):
        d = vectors.lowrank_project(d, "embedding", basis, mode, out=mode)
    return d.drop("embedding")


@query("soft_weight_project")
def _(t):
    basis, values = global_basis(t)
    k = rank_by_rule(values, "energy", 8)
    d = vectors.soft_weight_project(emb(t).select("vec_id", "embedding"), "embedding", basis[:, :k], values[:k], 0.5, out="soft")
    for norm in ("var", "degree"):
        d = vectors.soft_weight_project(d, "embedding", basis[:, :k], values[:k], normalise=norm, out=norm)
    return d.drop("embedding")


@query("block_spectral")
def _(t):
    return vectors.block_spectral(emb(t), "label", "vec_id", "embedding", DIM, 24, 10, plan=fold_plan(t))


@query("shuffled_history_control", f"""WITH p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
w AS (SELECT *, pos - least(32, pos + 1) + 1 + {hu("'0:' || label || ':' || pos")} % least(32, pos + 1) AS src FROM p)
SELECT w.label, w.vec_id, p.vec_id AS source FROM w JOIN p ON p.label = w.label AND p.pos = w.src""")
def _(t):
    return vectors.shuffled_history_control(emb(t), "label", "vec_id", plan=fold_plan(t))


@query("distributed_covariance", """WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT a.i, b.i AS j, covar_pop(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE)) AS covariance, corr(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE)) AS correlation FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(covariance, 8) + 0e0 AS covariance, round(correlation, 8) + 0e0 AS correlation FROM c""")
def _(t):
    return vectors.distributed_covariance(emb(t), "embedding", DIM).select("i", "j", *rr("covariance", "correlation"))


@query("engagement_summary", with_(LOGS, """SELECT run, count(*) AS n_logged, min(loss) AS lowest, max(loss) AS highest, round(avg(CASE WHEN loss BETWEEN 10e0 AND 60e0 THEN 1e0 ELSE 0e0 END), 8) AS share_inside,
 round(avg(CASE WHEN loss < 10e0 THEN 1e0 ELSE 0e0 END), 8) AS share_below, round(avg(CASE WHEN loss > 60e0 THEN 1e0 ELSE 0e0 END), 8) AS share_above, round(avg(CASE WHEN step >= 20 THEN loss END), 7) AS late_mean,
 round(avg(loss - step), 7) + 0e0 AS gap_mean, round(quantile_cont(loss, 0.5), 8) AS median_all, round(quantile_cont(CASE WHEN step >= 20 THEN loss END, 0.25), 8) AS q25_late,
 round(quantile_cont(CASE WHEN step >= 20 THEN loss END, 0.5), 8) AS median_late, round(quantile_cont(CASE WHEN step >= 20 THEN loss END, 0.75), 8) AS q75_late FROM logs GROUP BY run"""))
def _(t):
    got = vectors.engagement_summary(t.logs(), "run", "step", "loss", 20, 10.0, 60.0, "loss", "step", plan=plan_groups(t.logs(), ["run"]))
    return got.select("run", "n_logged", "lowest", "highest", *rr("share_inside", "share_below", "share_above"), *rr("late_mean", "gap_mean", digits=7),
                      *rr("median_all", "q25_late", "median_late", "q75_late"))


# ---- models ---------------------------------------------------------------------------

LINEAR = np.array([[((m * 7 + f * 3) % 11 - 5) / 10.0 for m in range(4)] for f in range(P)])
DOTS = " UNION ALL ".join(
    f"SELECT id, era, 'm{m}' AS model, round({' + '.join(f'features[{f + 1}]/4e0*({float(LINEAR[f, m])!r}e0)' for f in range(P))}, 8) + 0e0 AS prediction FROM panel" for m in range(4))


@query("score_linear_many", with_(PANEL, DOTS))
def _(t):
    return models.score_linear_many(t.panel(), LINEAR, [f"m{m}" for m in range(4)]).select("id", "era", "model", *rr("prediction"))


STEPS, B = 50, 32
TRAIN_SQL = f"""r AS (SELECT o_orderkey AS id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS era FROM orders),
st AS (SELECT unnest(range({STEPS})) AS step), sl AS (SELECT step, slot FROM st CROSS JOIN (SELECT unnest(range({B})) AS slot) s),
ra AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM r), re AS (SELECT id, era, row_number() OVER (PARTITION BY era ORDER BY id) - 1 AS pos FROM r),
ec AS (SELECT era, n, row_number() OVER (ORDER BY era) - 1 AS e FROM (SELECT era, count(*) AS n FROM r GROUP BY era)),
ew AS (SELECT era, n, row_number() OVER (ORDER BY era) - 1 AS e FROM (SELECT era, count(*) AS n FROM r GROUP BY era) WHERE n >= {B + 8}),
a AS (SELECT 'rows' AS mode, step, slot, id, false AS held_out FROM sl JOIN ra ON pos = {hu("'5:rows:' || step || ':' || slot")} % (SELECT count(*) FROM r)),
b AS (SELECT 'era' AS mode, step, slot, re.id, false AS held_out FROM sl JOIN ec ON ec.e = {hu("'5:era:' || step")} % (SELECT count(*) FROM ec) JOIN re ON re.era = ec.era AND re.pos = {hu("'5:slot:' || step || ':' || slot")} % ec.n),
w0 AS (SELECT step, ew.era, ew.n, CAST(ceil(sqrt(ew.n)) AS BIGINT) AS a FROM st JOIN ew ON ew.e = {hu("'5:within:' || step")} % (SELECT count(*) FROM ew)),
w1 AS (SELECT *, CAST(ceil(n / CAST(a AS DOUBLE)) AS BIGINT) AS b FROM w0),
w2 AS (SELECT *, unnest(range(least(a*b, {B + 8} + a*b - n))) AS cell FROM w1), w3 AS (SELECT *, cell % a AS x, cell // a AS y FROM w2),
w4 AS (SELECT * REPLACE ((x + {hu("'5:mix:' || step || ':0:' || y")}) % a AS x) FROM w3), w5 AS (SELECT * REPLACE ((y + {hu("'5:mix:' || step || ':1:' || x")}) % b AS y) FROM w4),
w6 AS (SELECT * REPLACE ((x + {hu("'5:mix:' || step || ':2:' || y")}) % a AS x) FROM w5), w7 AS (SELECT * REPLACE ((y + {hu("'5:mix:' || step || ':3:' || x")}) % b AS y) FROM w6),
w8 AS (SELECT step, era, x + a*y AS pos, row_number() OVER (PARTITION BY step ORDER BY cell) AS k FROM w7 WHERE x + a*y < n),
c AS (SELECT 'within' AS mode, step, k - 1 AS slot, re.id, k > {B} AS held_out FROM w8 JOIN re USING (era, pos) WHERE k <= {B + 8})"""


@query("batch_assignment", with_(TRAIN_SQL, "SELECT mode, CAST(step AS INT) AS step, CAST(slot AS INT) AS slot, id, held_out FROM (FROM a UNION ALL FROM b UNION ALL FROM c)"))
def _(t):
    parts = [models.batch_assignment(t.eras(), m, B, STEPS, 5, 8 if m == "within" else 0, plan=t.plan()).withColumn("mode", F.lit(m)) for m in ("rows", "era", "within")]
    d = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return d.select("mode", "step", F.col("slot").cast("int").alias("slot"), "id", "held_out")


W0 = [0.1, -0.2, 0.3, 0.05, -0.1, 0.2]
RES = " + ".join(f"features[{f + 1}]/4e0*({w}e0)" for f, w in enumerate(W0))


@query("era_gradients", with_(PANEL + f", g AS (SELECT era, ({RES}) - target AS res, unnest(features)/4e0 AS x, unnest(range(len(features))) AS feature FROM panel WHERE target IS NOT NULL)",
    "SELECT era, CAST(feature AS INT) AS feature, round(2e0*sum(res*x)/count(*), 12) + 0e0 AS gradient FROM g GROUP BY 1, 2"))
def _(t):
    d = t.panel().where(F.col("target").isNotNull())
    return models.era_gradients(d, np.array(W0)).select("era", "feature", *rr("gradient", digits=12))
