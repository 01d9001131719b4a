"""Registered queries of the fits over many cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.operators import encode, fits, models, scores, trees
from fieldlens.plans import bindings as b
from fieldlens.plans.queries import query, r, rounded
from fieldlens.sources.steps import written


def _rows(spark, sf, cells: int):
    l_ = b.table(spark, sf, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return l_.select(
        (F.col("l_orderkey") % cells).alias("cell"), (F.floor(F.col("l_orderkey") / 8) % 5).cast("int").alias("fold"), (F.col("l_quantity") / 50).alias("q"),
        (F.col("l_discount") * 10).alias("d"), (F.col("l_extendedprice") / 1000).alias("y"), flag.alias("flag"), (F.col("l_linenumber") - 1).cast("int").alias("place"),
    )


def _lines(cells: int) -> str:
    return f"""l AS (SELECT l_orderkey % {cells} AS cell, (l_orderkey // 8) % 5 AS fold, l_quantity / 50 AS q, l_extendedprice / 1000 AS y,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag FROM lineitem)"""


def _newton(ids: str, penalty: str) -> str:
    """Newton steps of two coefficients from counted rows d(ids, q, n, hits); ids end in the label."""
    p = "1 / (1 + exp(-(a + b * q)))"
    h = f"n * ({p}) * (1 - {p})"
    s_ids = ", ".join(f"s.{c.strip()}" for c in ids.split(","))
    down = "(h11 * h22 - h12 * h12)"
    return f"""sides AS (SELECT {ids}, sum(n) AS n, sum(hits) AS hits FROM d GROUP BY ALL),
  s(i, {ids}, a, b) AS (SELECT 0, {ids}, 0::DOUBLE, 0::DOUBLE FROM sides WHERE hits > 0 AND hits < n UNION ALL
    SELECT i + 1, {ids}, a - (h22 * g1 - h12 * g2) / {down}, b - (h11 * g2 - h12 * g1) / {down} FROM (
      SELECT s.i, {s_ids}, a, b, sum(n * {p} - hits) / sum(n) AS g1, sum(q * (n * {p} - hits)) / sum(n) + {penalty} * b AS g2,
        sum({h}) / sum(n) AS h11, sum(q * {h}) / sum(n) AS h12, sum(q * q * {h}) / sum(n) + {penalty} AS h22
      FROM s JOIN d USING ({ids}) WHERE i < 15 GROUP BY s.i, {s_ids}, a, b))"""


@query(f"""WITH RECURSIVE {_lines(7)}, d AS (SELECT cell, label, q, count(*)::DOUBLE AS n, count_if(flag = label)::DOUBLE AS hits FROM l, range(4) AS k(label) GROUP BY ALL), {_newton('cell, label', '0.05')}
  SELECT cell, cast(sides.label AS INTEGER) AS label, cast(n AS BIGINT) AS n, {r('coalesce(a, ln((hits + 0.5) / (n - hits + 0.5)))', 'b0', 6)}, {r('coalesce(b, 0)', 'b1', 6)}, a IS NULL AS constant
  FROM sides LEFT JOIN (SELECT * FROM s WHERE i = 15) USING (cell, label)""")
def ml1_one_vs_rest(spark, sf):
    """Each flag against the rest in every cell, and a label that no row has."""
    f = fits.logistic_fits(_rows(spark, sf, 7), ["cell"], ["q"], "flag", [0, 1, 2, 3], [0.05])
    at = lambda i: F.get("beta", F.lit(i)).alias(f"b{i}")
    return rounded(f.select("cell", "label", "n", at(0), at(1), "constant"), 6)


@query(f"""WITH RECURSIVE {_lines(3)}, d AS (
    SELECT cell, candidate, penalty, f AS fold, q, count(*)::DOUBLE AS n, count_if(flag = 2)::DOUBLE AS hits FROM l, (VALUES (0, 1.0::DOUBLE), (1, 0.01::DOUBLE)) AS c(candidate, penalty), range(5) AS k(f) WHERE l.fold <> f GROUP BY ALL
  ), {_newton('cell, candidate, penalty, fold', 's.penalty')}, held AS (
    SELECT l.cell, candidate, l.fold, -avg(ln(greatest(CASE WHEN flag = 2 THEN p ELSE 1 - p END, 1e-12))) AS loss
    FROM (SELECT *, 1 / (1 + exp(-(a + b * q))) AS p FROM l JOIN s USING (cell, fold) WHERE i = 15) l GROUP BY ALL
  ), m AS (SELECT cell, candidate, avg(loss) AS mean, stddev_samp(loss) AS sd FROM held GROUP BY ALL)
  SELECT cell, candidate, {r('mean', 'mean', 6)}, {r('sd', 'sd', 6)}, candidate = first_value(candidate) OVER (PARTITION BY cell ORDER BY mean, candidate) AS chosen FROM m""")
def ml6_logistic_folds(spark, sf):
    """Two penalties, five folds, all fitted in one job: which is least by held-out log loss in each cell."""
    losses = fits.logistic_losses(_rows(spark, sf, 3), ["cell"], ["q"], "flag", [2], [1.0, 0.01], "fold", [0, 1, 2, 3, 4])
    return rounded(models.choose(losses, 5, ["cell"]), 6)


@query(f"""WITH {_lines(7)}, c(candidate, penalty) AS (VALUES (0, 1.0::DOUBLE), (1, 100.0::DOUBLE), (2, 10000.0::DOUBLE)),
  m AS (SELECT cell, fold, count(*)::DOUBLE AS n, sum(q) AS sx, sum(q * q) AS sxx, sum(y) AS sy, sum(q * y) AS sxy, sum(y * y) AS syy FROM l GROUP BY ALL),
  w AS (SELECT cell, fold, n, sx, sxx, sy, sxy, syy, sum(n) OVER p - n AS tn, sum(sx) OVER p - sx AS tx, sum(sxx) OVER p - sxx AS txx, sum(sy) OVER p - sy AS ty, sum(sxy) OVER p - sxy AS txy FROM m WINDOW p AS (PARTITION BY cell)),
  f AS (SELECT *, (tn * txy - tx * ty) / (tn * (txx + penalty) - tx * tx) AS b1 FROM w, c),
  e AS (SELECT cell, candidate, fold, (syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx) / n AS loss FROM (SELECT *, (ty - b1 * tx) / tn AS b0 FROM f)),
  g AS (SELECT cell, candidate, avg(loss) AS mean, stddev_samp(loss) AS sd FROM e GROUP BY ALL)
  SELECT cell, candidate, {r('mean', 'mean', 5)}, {r('sd', 'sd', 5)}, candidate = first_value(candidate) OVER (PARTITION BY cell ORDER BY mean, candidate) AS chosen FROM g""")
def ml6_ridge_folds(spark, sf):
    """Three penalties, five folds, from one pass of moments by cell and fold."""
    losses = fits.ridge_losses(_rows(spark, sf, 7), ["cell"], ["q"], "y", [1.0, 100.0, 10000.0], "fold")
    return rounded(models.choose(losses, 5, ["cell"]), 5)


@query(f"""WITH l AS (SELECT l_orderkey % 7 AS cell, l_quantity AS q, l_tax * 100 AS t, l_extendedprice / 1000 AS y FROM lineitem),
  m AS (SELECT cell, count(*) AS n, sum(q) AS a, sum(t) AS b, sum(q * q) + 1 AS qq, sum(q * t) AS qt, sum(t * t) + 1 AS tt, sum(y) AS y, sum(q * y) AS qy, sum(t * y) AS ty FROM l GROUP BY cell),
  c AS (SELECT cell, n, a, b, y, qq - a * a / n AS qq, qt - a * b / n AS qt, tt - b * b / n AS tt, qy - a * y / n AS qy, ty - b * y / n AS ty FROM m),
  s AS (SELECT *, (tt * qy - qt * ty) / (qq * tt - qt * qt) AS b1, (qq * ty - qt * qy) / (qq * tt - qt * qt) AS b2 FROM c)
  SELECT cell, {r('(y - b1 * a - b2 * b) / n', 'b0', 5)}, {r('b1', 'b1', 5)}, {r('b2', 'b2', 5)} FROM s""")
def ml2_ridge_normal_equations(spark, sf):
    l_ = b.table(spark, sf, "lineitem")
    rows = l_.select((F.col("l_orderkey") % 7).alias("cell"), F.col("l_quantity").alias("q"), (F.col("l_tax") * 100).alias("t"), (F.col("l_extendedprice") / 1000).alias("y"))
    beta = encode.ridge_fit(encode.ridge_moments(rows, ["cell"], ["q", "t"], "y"), ["cell"], 3, 1.0)
    return rounded(beta.select("cell", *[F.get("beta", F.lit(i)).alias(f"b{i}") for i in range(3)]), 5)


@query()
def ml3_boosted_binary(spark, sf):
    """Boosted trees of each cell, learned from four folds: loss of the fifth, and of the share alone."""
    rows = _rows(spark, sf, 5).withColumn("label", (F.col("flag") == 2).cast("int"))
    d = trees.Boosting(3, True, trees=3, depth=2, rate=0.3, bins=16, least_rows=20)
    model = trees.boosted_fits(rows.where("fold > 0"), ["cell"], ["q", "d", "y"], "label", d)
    scored = trees.boosted_score(rows.where("fold = 0"), model, ["cell"], ["q", "d", "y"], d)
    return rounded(scored.groupBy("cell").agg(F.count("prediction").alias("n"), F.avg(scores.brier(F.col("prediction"), F.col("label"))).alias("brier"), F.avg("label").alias("share")), 6)


@query()
def ml3_boosted_thresholds(spark, sf):
    """A distribution of the line's place from boosted residuals of its thresholds: ranked probability score by cell."""
    rows = _rows(spark, sf, 3)
    base = written(rows.groupBy("cell").agg(F.array(*[F.avg((F.col("place") <= k).cast("double")) for k in range(7)]).alias("base")))
    rows, x, over = rows.select("cell", "q", "y", "place"), ["q", "y", "t"], ("t", [k / 6.0 for k in range(6)])
    residuals = [((F.col("place") <= k).cast("double") - F.get("base", F.lit(k))).alias(f"residual{k}") for k in range(6)]
    d = trees.Boosting(3, False, trees=2, depth=3, rate=0.5, bins=16, least_rows=20)
    fitted = trees.boosted_fits(rows.join(base, "cell").select("cell", "q", "y", *residuals), ["cell"], x, [f"residual{k}" for k in range(6)], d, over)
    scored = trees.boosted_score(rows, fitted, ["cell"], x, d, over=over)
    apart = [F.get("prediction", F.lit(k)).alias(f"p{k}") for k in range(6)]
    same = scored.groupBy("cell", "place", *apart).agg(F.count("*").alias("n")).join(base, "cell")  # rows in the same leaves have one distribution
    residual = F.when(F.col("p0").isNotNull(), F.array(*[F.col(f"p{k}") for k in range(6)], F.lit(0.0)))
    pmf = same.select("cell", "place", "n", models.residual_pmf(residual, F.col("base")).alias("pmf"))
    rps = fn.total(F.transform(fn.cumulative(F.col("pmf")), lambda c, i: F.pow(c - (F.col("place") <= i).cast("double"), F.lit(2.0))))
    mean = F.sum(rps * F.col("n")) / F.sum(F.when(rps.isNotNull(), F.col("n")))
    return rounded(pmf.groupBy("cell").agg(F.sum("n").alias("n"), mean.alias("rps")), 6)


@query()
def ml3_boosted_horizons(spark, sf):
    """A quantity some lines ahead by one boosted model over all horizons: squared error by horizon."""
    l_ = b.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    own = lambda c: F.max(F.when(F.col("n") == 1, F.col(c)))
    one = l_.groupBy("l_orderkey").agg(  # of a few lines an order; rows then carry what they need, without joins
        own("q").alias("q1"), own("t").alias("t1"), (F.max("n") - 1).alias("length"), F.count_if(F.col("n") == 1).alias("firsts"), F.collect_list(F.struct((F.col("n") - 1).alias("h"), "q")).alias("lines")
    )
    h = encode.horizon_rows(one.where("length > 0 and firsts > 0"), "l_orderkey", "length", 6, ["q1", "t1", "lines"])
    h = h.withColumn("then", F.filter("lines", lambda x: x["h"] == F.col("h"))).where(F.size("then") > 0)
    target = F.array_max(F.transform("then", lambda x: x["q"]))
    rows = written(h.select("h", "t", "root", "square", "q1", "t1", target.alias("target"), F.lit(1).alias("all")))
    d = trees.Boosting(5, False, trees=2, depth=3, rate=0.5, bins=16, least_rows=20)
    x = ["q1", "t1", "t", "root", "square"]
    scored = trees.boosted_score(rows, trees.boosted_fits(rows, ["all"], x, "target", d), ["all"], x, d)
    return rounded(scored.groupBy("h").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("prediction") - F.col("target"), F.lit(2.0))).alias("mse")), 6)
