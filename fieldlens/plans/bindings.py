"""Role bindings: the operators' tables as views of the driver's tables, in Spark and, for the oracles, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics panel from lineitem: repeat 1-20, six models, seven sizes."""
    l_ = table(spark, sf_dir, "lineitem")
    mean = lambda c: F.rint(F.sum(c) * 100) / (F.count("*") * 100)  # noqa: E731  values have two decimals
    return l_.groupBy(
        (F.col("l_orderkey") % 20 + 1).cast("int").alias("repeat"), F.concat("l_returnflag", "l_linestatus").alias("model"), (F.col("l_linenumber") * 20).alias("n_train")
    ).agg(
        mean("l_discount").alias("loss"), mean(F.col("l_tax") + 0.05).alias("null_loss"), mean("l_quantity").alias("width"),
        mean(F.when(F.col("l_quantity") > 5, 1.0).otherwise(0.0)).alias("coverage"),
    )


PANEL = """panel AS (
  SELECT cast(l_orderkey % 20 + 1 AS INTEGER) AS repeat, l_returnflag || l_linestatus AS model, l_linenumber * 20 AS n_train,
    round(sum(l_discount) * 100) / (count(*) * 100) AS loss, round(sum(l_tax + 0.05) * 100) / (count(*) * 100) AS null_loss, round(sum(l_quantity) * 100) / (count(*) * 100) AS width,
    round(sum(CASE WHEN l_quantity > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100) / (count(*) * 100) AS coverage
  FROM lineitem GROUP BY ALL)"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream as frames of plays: play = user, frame = place in time, marker = event type, p = value / 100 at most 1."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("play"), place.alias("frame"), F.col("event_type").alias("marker"), "value", F.least(F.col("value") / 60, F.lit(1.0)).alias("p"))


MARKS = """marks AS (
  SELECT user_id AS play, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS frame, event_type AS marker, value,
    least(value / 60, 1.0::DOUBLE) AS p FROM events)"""


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking rows from lineitem: play = order, frame = line number, object = supplier; one row per key. Rows are dealt by play, so that what groups by
    play and more needs no further shuffle."""
    from fieldlens.operators.frames import first_occurrence

    l_ = first_occurrence(
        table(spark, sf_dir, "lineitem").repartition("l_orderkey"), ["l_orderkey", "l_linenumber", "l_suppkey"],
        ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    )
    return l_.select(
        F.col("l_orderkey").alias("play"), F.col("l_linenumber").alias("frame"), F.col("l_suppkey").alias("obj"), (F.col("l_quantity") * 2).alias("x"),
        (F.col("l_extendedprice") / 2000).alias("y"), (F.col("l_tax") * 100).alias("s"), (F.col("l_partkey") % 360).cast("double").alias("dir"),
        (F.col("l_returnflag") == "R").alias("offense"), (F.col("l_linestatus") == "F").alias("left"),
    )


TRACKING = """tracking AS (
  SELECT l_orderkey AS play, l_linenumber AS frame, l_suppkey AS obj, l_quantity * 2 AS x, l_extendedprice / 2000 AS y, l_tax * 100 AS s,
    cast(l_partkey % 360 AS DOUBLE) AS dir, l_returnflag = 'R' AS offense, l_linestatus = 'F' AS "left"
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey
    ORDER BY l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS r FROM lineitem) WHERE r = 1)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games = customers, stratum = their nation's region."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("game"), F.col("r_name").alias("stratum"))


GAMES = """games AS (
  SELECT c_custkey AS game, r_name AS stratum FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary predictions: one row per order, game = customer, y = status F, p from its price, part by parity."""
    o = table(spark, sf_dir, "orders")
    p = F.round(F.lit(0.02) + 0.96 * (F.col("o_totalprice") % 1000) / 1000, 6)
    return o.select(
        F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("game"), F.col("o_orderpriority").alias("cell"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        p.alias("p"), (F.col("o_orderkey") % 2 == 0).alias("is_cal"),
    )


BINARY = """bin AS (
  SELECT o_orderkey AS "row", o_custkey AS game, o_orderpriority AS cell, cast(o_orderstatus = 'F' AS INTEGER) AS y,
    round(0.02::DOUBLE + 0.96::DOUBLE * (o_totalprice % 1000) / 1000, 6) AS p, o_orderkey % 2 = 0 AS is_cal FROM orders)"""


def pmfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities: squares of the embedding's components plus a floor, rounded and normalised; y = 6 * label."""
    e = table(spark, sf_dir, "embeddings")
    raw = F.transform("embedding", lambda x: F.round(x.cast("double") * x.cast("double") + 0.001, 6))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    e = e.withColumn("raw", raw).withColumn("tot", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x))
    return e.select(
        F.col("vec_id").alias("row"), (F.col("vec_id") % 25).alias("game"), (F.col("label") * 6).cast("int").alias("y"),
        F.transform("raw", lambda x: x / F.col("tot")).alias("pmf"), (F.col("vec_id") % 2 == 0).alias("is_cal"), (F.col("vec_id") % 3).alias("cell"),
    )


PMFS = """raw AS (
  SELECT vec_id, label, [round(cast(x AS DOUBLE) * cast(x AS DOUBLE) + 0.001::DOUBLE, 6) FOR x IN embedding] AS r FROM embeddings
), flat AS (
  SELECT vec_id AS "row", vec_id % 25 AS game, label * 6 AS y, vec_id % 2 = 0 AS is_cal, vec_id % 3 AS cell, unnest(r) AS v, unnest(range(len(r))) AS k FROM raw
), pmf AS (
  SELECT "row", game, y, is_cal, cell, k, v / sum(v) OVER (PARTITION BY "row") AS p,
    sum(v) OVER (PARTITION BY "row" ORDER BY k) / sum(v) OVER (PARTITION BY "row") AS cdf FROM flat)"""


def scrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with several objects, from lineitem: play = eight orders, frame = line number, object = order; one row per key.
    The last order of a play is the ball, the first of the red side holds it; blue defends. Rows are dealt by play and sorted by play and frame, so that
    what groups by these needs no further shuffle or sort."""
    from fieldlens.operators.frames import first_occurrence

    l_ = first_occurrence(
        table(spark, sf_dir, "lineitem").withColumn("play", F.floor(F.col("l_orderkey") / 8)).repartition("play"), ["play", "l_linenumber", "l_orderkey"],
        ["l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    )
    at = F.col("l_orderkey") % 8
    names = F.array(*[F.lit(p) for p in ("QB", "WR", "TE", "RB", "OL", "DE", "ILB", "CB", "K", "XX")])
    side = F.when(at == 7, "football").when(at < 4, "red").otherwise("blue")
    return l_.select(
        "play", F.col("l_linenumber").alias("frame"), F.col("l_orderkey").alias("obj"), side.alias("team"),
        F.get(names, (F.col("l_partkey") % 10).cast("int")).alias("position"), (F.col("l_quantity") * 2).alias("x"), (F.col("l_extendedprice") / 2000).alias("y"),
        (F.col("l_tax") * 100).alias("s"), F.when(F.col("l_discount") > 0, F.col("l_discount") * 10).alias("a"), (F.col("l_partkey") % 360).cast("double").alias("dir"),
        F.when(F.col("l_suppkey") % 9 > 0, (F.col("l_suppkey") * 7 % 360).cast("double")).alias("o"), F.when(F.floor(F.col("l_orderkey") / 8) % 2 == 0, "left").otherwise("right").alias("playDirection"),
        F.when(F.col("l_quantity") > 47, "tackle").when(F.col("l_linenumber") == 1, "snap").otherwise("none").alias("marker"), (at == 0).alias("carrier"), (F.col("l_linestatus") == "F").alias("run"),
    )


SCRUM = """scrum AS (
  SELECT l_orderkey // 8 AS play, l_linenumber AS frame, l_orderkey AS obj, CASE WHEN l_orderkey % 8 = 7 THEN 'football' WHEN l_orderkey % 8 < 4 THEN 'red' ELSE 'blue' END AS team,
    ['QB', 'WR', 'TE', 'RB', 'OL', 'DE', 'ILB', 'CB', 'K', 'XX'][l_partkey % 10 + 1] AS position, l_quantity * 2 AS x, l_extendedprice / 2000 AS y, l_tax * 100 AS s,
    CASE WHEN l_discount > 0 THEN l_discount * 10 END AS a, cast(l_partkey % 360 AS DOUBLE) AS dir, CASE WHEN l_suppkey % 9 > 0 THEN cast(l_suppkey * 7 % 360 AS DOUBLE) END AS o,
    CASE WHEN (l_orderkey // 8) % 2 = 0 THEN 'left' ELSE 'right' END AS "playDirection", CASE WHEN l_quantity > 47 THEN 'tackle' WHEN l_linenumber = 1 THEN 'snap' ELSE 'none' END AS marker,
    l_orderkey % 8 = 0 AS carrier, l_linestatus = 'F' AS run
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS r FROM lineitem) WHERE r = 1)"""


def parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """binary() with a part: a fifth of the rows trains, the rest calibrates or tests by parity."""
    part = F.when(F.col("row") % 5 == 4, "train").when(F.col("row") % 2 == 0, "calibration").otherwise("test")
    return binary(spark, sf_dir).withColumn("part", part)
