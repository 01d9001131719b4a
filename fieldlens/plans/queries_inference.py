"""Registered queries of the distribution functions and the bootstrap intervals of spread."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.operators import inference, panel
from fieldlens.plans import bindings as b
from fieldlens.plans.queries import _CI, _DRAWS, query, r, rounded

_B = 200


def _double_factorial(k: int) -> float:
    out = 1.0
    for i in range(1, 2 * k + 2, 2):
        out *= i
    return out


def _cdf(z: str) -> str:
    """Normal distribution function of an SQL expression between -6 and 6: the power series about 0."""
    terms = " + ".join(f"power({z}, {2 * k + 1}) / {_double_factorial(k)!r}" for k in range(70))
    return f"(0.5::DOUBLE + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * ({terms}))"


#: Quantile of the normal at each share of 200 draws, by the count of draws.
_QUANTILES = f"nq AS (SELECT unnest(range({_B + 1})) AS below, unnest([{', '.join(repr(NormalDist().inv_cdf(min(max(j / _B, 0.5 / _B), 1 - 0.5 / _B))) for j in range(_B + 1))}]::DOUBLE[]) AS z0)"


def _bca(ids: str) -> str:
    """CTE iv(ids, observed, lower, upper) from obs(ids, observed), boot(ids, v) and jack(ids, v)."""
    at = lambda p: f"list_extract(vs, cast(floor({p} * {_B - 1}) AS BIGINT) + 1) + ({p} * {_B - 1} - floor({p} * {_B - 1})) * (list_extract(vs, least(cast(floor({p} * {_B - 1}) AS BIGINT) + 2, {_B})) - list_extract(vs, cast(floor({p} * {_B - 1}) AS BIGINT) + 1))"
    z = NormalDist().inv_cdf(0.975)
    return f"""{_QUANTILES}, st AS (SELECT {ids}, any_value(observed) AS observed, count_if(v < observed) AS below, list(v ORDER BY v) AS vs FROM boot JOIN obs USING ({ids}) GROUP BY {ids}),
  jm AS (SELECT *, avg(v) OVER (PARTITION BY {ids}) - v AS d FROM jack),
  ac AS (SELECT {ids}, CASE WHEN 6 * power(sum(d * d), 1.5::DOUBLE) > 2.220446049250313e-16 THEN sum(d * d * d) / (6 * power(sum(d * d), 1.5::DOUBLE)) ELSE 0 END AS a FROM jm GROUP BY {ids}),
  zs AS (SELECT {ids}, observed, vs, z0 + (z0 - {z!r}) / (1 - a * (z0 - {z!r})) AS zl, z0 + (z0 + {z!r}) / (1 - a * (z0 + {z!r})) AS zu FROM st JOIN ac USING ({ids}) JOIN nq USING (below)),
  ps AS (SELECT *, {_cdf('zl')} AS pl, {_cdf('zu')} AS pu FROM zs),
  iv AS (SELECT {ids}, observed, least({at('pl')}, {at('pu')}) AS lower, greatest({at('pl')}, {at('pu')}) AS upper FROM ps)"""


_T19 = repr(fn.t_critical(0.95, 19))


@query(f"""WITH {_CI} SELECT n_train, "left", "right", {r('mean', 'mean', 8)}, {r(f'mean - {_T19} * se', 't_lower', 7)}, {r(f'mean + {_T19} * se', 't_upper', 7)} FROM ci""")
def inf4_t_intervals(spark, sf):
    i = inference.max_t_intervals(panel.paired_models(b.panel(spark, sf), "loss"), ["n_train", "left", "right"], 20, _B, 42)
    digits = {"mean": 8, "t_lower": 7, "t_upper": 7}
    return i.select("n_train", "left", "right", *[(F.round(c, k) + 0.0).alias(c) for c, k in digits.items()])


_SD = f"""{b.PANEL}, {_DRAWS}, obs AS (SELECT model, n_train, stddev_samp(loss) AS observed FROM panel GROUP BY ALL),
  boot AS (SELECT model, n_train, draw, stddev_samp(loss) AS v FROM panel JOIN draws ON k = repeat - 1 GROUP BY ALL),
  jack AS (SELECT a.model AS model, a.n_train AS n_train, a.repeat, stddev_samp(c.loss) AS v FROM panel a JOIN panel c ON a.model = c.model AND a.n_train = c.n_train AND a.repeat <> c.repeat GROUP BY ALL)"""


@query(f"WITH {_SD}, {_bca('model, n_train')} SELECT model, n_train, {r('observed', 'sd', 7)}, {r('lower', 'lower', 7)}, {r('upper', 'upper', 7)} FROM iv")
def inf5_bca_sd(spark, sf):
    return rounded(inference.bca_sd(b.panel(spark, sf), "loss", ["model", "n_train"], 20, _B, 42), 7)


_LOG = "ln(greatest({a}, 1e-12) / greatest({b}, 1e-12))"


@query(f"""WITH {_SD.replace('obs AS', 'obs1 AS').replace('boot AS', 'boot1 AS').replace('jack AS', 'jack1 AS')},
  obs AS (SELECT x.n_train AS n_train, x.model AS "left", y.model AS "right", {_LOG.format(a='x.observed', b='y.observed')} AS observed FROM obs1 x JOIN obs1 y ON x.n_train = y.n_train AND x.model < y.model),
  pairs AS (SELECT x.n_train AS n_train, x.model AS "left", y.model AS "right", x.v AS lv, y.v AS rv FROM boot1 x JOIN boot1 y ON x.n_train = y.n_train AND x.draw = y.draw AND x.model < y.model),
  boot AS (SELECT n_train, "left", "right", {_LOG.format(a='lv', b='rv')} AS v FROM pairs),
  jack AS (SELECT x.n_train AS n_train, x.model AS "left", y.model AS "right", {_LOG.format(a='x.v', b='y.v')} AS v FROM jack1 x JOIN jack1 y ON x.n_train = y.n_train AND x.repeat = y.repeat AND x.model < y.model),
  floored AS (SELECT n_train, "left", "right", count_if(lv <= 1e-12 OR rv <= 1e-12) AS zero_draws FROM pairs GROUP BY ALL), {_bca('n_train, "left", "right"')}
  SELECT n_train, "left", "right", {r('exp(observed)', 'ratio', 6)}, {r('exp(lower)', 'lower', 6)}, {r('exp(upper)', 'upper', 6)}, zero_draws FROM iv JOIN floored USING (n_train, "left", "right")""")
def inf6_bca_ratio(spark, sf):
    return rounded(inference.bca_log_ratio(b.panel(spark, sf), "loss", ["n_train"], 20, _B, 42), 6)


@query(f"""WITH {b.PANEL} SELECT a.model AS model, a.n_train AS n_train, a.repeat AS repeat, {r('stddev_samp(c.loss)', 'without', 8)}
  FROM panel a JOIN panel c ON a.model = c.model AND a.n_train = c.n_train AND a.repeat <> c.repeat GROUP BY ALL""")
def inf7_leave_one_out(spark, sf):
    e = inference.estimands(b.panel(spark, sf), ["model", "n_train"], "loss")
    out = e.select("model", "n_train", F.posexplode(inference.jackknife_sd(F.col("values"))).alias("k", "without"))
    return rounded(out.select("model", "n_train", (F.col("k") + 1).cast("int").alias("repeat"), "without"), 8)


_T = {
    1: "0.5::DOUBLE + atan(t) / pi()", 2: "0.5::DOUBLE + t / (2 * sqrt(2 + t * t))", 3: "0.5::DOUBLE + (t / sqrt(3) / (1 + t * t / 3) + atan(t / sqrt(3))) / pi()",
    4: "0.5::DOUBLE + 3.0::DOUBLE / 8 * t / sqrt(1 + t * t / 4) * (1 - t * t / (1 + t * t / 4) / 12)",
}


@query(f"""WITH v AS (SELECT DISTINCT l_linenumber % 4 + 1 AS df, (l_quantity - 25) / 8 AS t FROM lineitem),
  c AS (SELECT df, t, CASE {' '.join(f'WHEN df = {k} THEN {e}' for k, e in _T.items())} END AS p FROM v)
  SELECT cast(df AS INTEGER) AS df, t, {r('p', 'student', 10)}, {r(_cdf('t'), 'normal', 10)}, {r('t', 'student_back', 7)}, {r('t', 'normal_back', 7)} FROM c""")
def fn20_distribution_functions(spark, sf):
    """Student and normal distribution functions, and their quantiles, which lead back."""
    v = b.table(spark, sf, "lineitem").select((F.col("l_linenumber") % 4 + 1).cast("int").alias("df"), ((F.col("l_quantity") - 25) / 8).alias("t")).distinct()
    c = v.withColumn("student", fn.t_cdf(F.col("t"), F.col("df"))).withColumn("normal", fn.normal_cdf(F.col("t")))
    back = [fn.t_quantiles(F.col("student"), F.col("df")).alias("student_back"), fn.normal_quantiles(F.col("normal")).alias("normal_back")]
    digits = {"student": 10, "normal": 10, "student_back": 7, "normal_back": 7}
    return c.select("*", *back).select("df", "t", *[(F.round(c, k) + 0.0).alias(c) for c, k in digits.items()])
