"""Split design: hash-ranked, stratified, nested splits of games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_key(item: Column, namespace: str, seed: Column | int) -> Column:
    """SHA-256 of item, namespace and seed: the order in which games are drawn (DES-3)."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    return F.sha2(F.concat_ws("|", item.cast("string"), F.lit(namespace), s.cast("string")).cast("binary"), 256)


def ranked(games: DataFrame, by: list[str], game: str, namespace: str, seed: Column | int, name: str = "place") -> DataFrame:
    return games.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(rank_key(F.col(game), namespace, seed), game)))


def strata(games: DataFrame, season: str, week: str) -> DataFrame:
    """Adds ``stratum``: the season where there are several, else the week (DES-2)."""
    several = F.size(F.collect_set(season).over(Window.partitionBy())) > 1
    text = F.when(several, F.concat(F.lit("season_"), F.col(season).cast("string"))).otherwise(F.concat(F.lit("week_"), F.lpad(F.col(week).cast("string"), 2, "0")))
    return games.withColumn("stratum", text)


def largest_remainder(cells: DataFrame, by: list[str], stratum: str, capacity: str, total: Column) -> DataFrame:
    """Adds ``allocation``: ``total`` over strata in proportion to capacity, floors first, then one more to the
    largest remainders, ties to the stratum's name; integers only (DES-4)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    c = cells.withColumn("__sum", F.sum(capacity).over(w)).withColumn("__t", total.cast("long"))
    c = c.withColumn("__base", F.expr(f"(__t * {capacity}) div __sum")).withColumn("__rem", F.col("__t") * F.col(capacity) % F.col("__sum"))
    c = c.withColumn("__left", F.col("__t") - F.sum("__base").over(w))
    c = c.withColumn("__p", F.row_number().over(w.orderBy(F.desc("__rem"), stratum)))
    return c.withColumn("allocation", F.col("__base") + (F.col("__p") <= F.col("__left")).cast("long")).drop("__sum", "__t", "__base", "__rem", "__left", "__p")


def hold_out(games: DataFrame, game: str, stratum: str, size: int, seed: int, namespace: str = "development") -> DataFrame:
    """Adds ``held_out``: the first games by rank of each stratum, as many as its share of ``size`` (DES-5)."""
    caps = games.groupBy(stratum).agg(F.count("*").alias("capacity"))
    caps = largest_remainder(caps, [], stratum, "capacity", F.lit(size))
    r = ranked(games, [stratum], game, namespace, seed).join(caps.select(stratum, "allocation"), stratum)
    return r.withColumn("held_out", F.col("place") <= F.col("allocation")).drop("place", "allocation")


def outer_splits(games: DataFrame, game: str, stratum: str, repeats: int, sizes: dict[str, int], seed: int) -> DataFrame:
    """``repeat, game, stratum, role``: each repeat deals every stratum's games by rank to the roles in order, by
    largest-remainder shares of each role's size; games left over have role null (DES-7, DES-14, DES-15)."""
    many = games.select(game, stratum).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    caps = games.groupBy(stratum).agg(F.count("*").alias("capacity"))
    out, start = None, F.lit(0).cast("long")
    for role, size in sizes.items():
        share = largest_remainder(caps.select(stratum, "capacity"), [], stratum, "capacity", F.lit(size)).select(stratum, F.col("allocation").alias(f"n_{role}"))
        out = share if out is None else out.join(share, stratum)
    r = ranked(many, ["repeat", stratum], game, "outer", F.col("repeat") + seed).join(out, stratum)
    role_of = F.lit(None).cast("string")
    for role in reversed(sizes):
        before = start
        for other in list(sizes)[: list(sizes).index(role)]:
            before = before + F.col(f"n_{other}")
        role_of = F.when((F.col("place") > before) & (F.col("place") <= before + F.col(f"n_{role}")), role).otherwise(role_of)
    return r.withColumn("role", role_of).select("repeat", game, stratum, "role", "place")


def balanced_order(splits: DataFrame, by: list[str], game: str, stratum: str, place: str) -> DataFrame:
    """Adds ``train_order``: games of the strata interleaved so that every prefix is near proportional; within a
    stratum they keep ``place`` (DES-8). Each position goes to the open stratum that is furthest behind its share,
    position * capacity / total - taken, ties to the stratum's name, in integers.

    The sequence of strata follows from the capacities alone: it is computed once for each vector of capacities, and
    games join it by stratum and place."""
    caps = splits.groupBy(*by, stratum).agg(F.count("*").alias("c"))
    vectors = caps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(stratum).alias("s"), "c"))).alias("v"))
    sizes = F.transform("v", lambda x: x["c"])
    distinct = vectors.select(sizes.alias("sizes")).distinct().withColumn("total", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    start = F.struct(F.transform("sizes", lambda c: F.lit(0).cast("long")).alias("taken"), F.array().cast("array<int>").alias("turns"))

    def turn(a: Column, position: Column) -> Column:
        behind = F.zip_with("sizes", a["taken"], lambda c, t: F.when(t < c, position * c - t * F.col("total")))
        pick = F.array_position(behind, F.array_max(behind)).cast("int")
        with_pick = F.concat(a["turns"], F.array(pick))
        return F.struct(F.transform(a["taken"], lambda t, i: t + (i + 1 == F.element_at(with_pick, -1)).cast("long")).alias("taken"), with_pick.alias("turns"))

    turns = distinct.select("sizes", F.posexplode(F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("total")), start, turn, lambda a: a["turns"])).alias("at", "pick"))
    turns = turns.withColumn("i", F.row_number().over(Window.partitionBy("sizes", "pick").orderBy("at")))
    slots = vectors.select(*by, "v", sizes.alias("sizes")).join(turns, "sizes")
    slots = slots.select(*by, F.element_at("v", F.col("pick"))["s"].alias(stratum), F.col("i").alias("__i"), (F.col("at") + 1).alias("train_order"))
    placed = splits.withColumn("__i", F.row_number().over(Window.partitionBy(*by, stratum).orderBy(place)))
    return placed.join(slots, [*by, stratum, "__i"]).select(*splits.columns, "train_order")


def nested_anchors(ordered: DataFrame, anchors: list[int]) -> DataFrame:
    """Each training prefix: rows of ``ordered`` for every anchor that reaches them (DES-9)."""
    return ordered.withColumn("n_train", F.explode(F.filter(F.array(*[F.lit(a) for a in anchors]), lambda a: a >= F.col("train_order"))))


def proportional_anchors(caps: DataFrame, stratum: str, capacity: str, anchors: list[int]) -> DataFrame:
    """Largest-remainder allocations for every anchor with ``shrinks``: whether a stratum gets fewer than at the
    anchor before, which makes the anchors not nested (DES-10)."""
    many = caps.withColumn("n_train", F.explode(F.array(*[F.lit(a) for a in anchors])))
    a = largest_remainder(many, ["n_train"], stratum, capacity, F.col("n_train"))
    before = F.lag("allocation").over(Window.partitionBy(stratum).orderBy("n_train"))
    return a.withColumn("shrinks", F.coalesce(F.col("allocation") < before, F.lit(False)))


def folds(games: DataFrame, game: str, stratum: str, k: int, seed: int) -> DataFrame:
    """Adds ``fold`` 0..k-1 (DES-6, DES-12): folds get total / k games, the first ones in the folds' hash order one more; the strata, in
    hash order, deal their games by rank to the folds, by largest remainders over what each fold has left, ties in
    the folds' order. So folds are balanced overall and by stratum. The strata (few) form one array."""
    order = F.transform(F.array_sort(F.array(*[F.struct(rank_key(F.lit(f), "fold_order", seed).alias("h"), F.lit(f).alias("f")) for f in range(k)])), lambda x: x["f"])
    caps = games.groupBy(stratum).agg(F.count("*").alias("n"))
    plan = caps.agg(F.array_sort(F.collect_list(F.struct(rank_key(F.col(stratum), "strata", seed).alias("h"), F.col(stratum).alias("s"), "n"))).alias("strata"), F.sum("n").alias("total"))
    plan = plan.withColumn("order", order).withColumn("open", F.transform("order", lambda f, i: F.expr(f"total div {k}") + (i < F.col("total") % k).cast("long")))
    none = F.array().cast(f"array<struct<s:{dict(games.dtypes)[stratum]},deal:array<bigint>>>")

    def deal(a: Column, x: Column) -> Column:
        """What a stratum deals to each fold: floors, then one more to the largest remainders."""
        left = F.aggregate(a["open"], F.lit(0).cast("long"), lambda t, o: t + o)
        exact = F.transform(a["open"], lambda o: F.struct(F.floor(x["n"] * o / left).alias("base"), (x["n"] * o % left).alias("rest")))
        spare = x["n"] - F.aggregate(exact, F.lit(0).cast("long"), lambda t, e: t + e["base"])
        ahead = lambda e, i: F.size(F.filter(exact, lambda o, j: (o["rest"] > e["rest"]) | ((o["rest"] == e["rest"]) & (j < i))))
        return F.transform(exact, lambda e, i: e["base"] + (ahead(e, i) < spare).cast("long"))

    def step(a: Column, x: Column) -> Column:
        out = F.concat(a["out"], F.array(F.struct(x["s"].alias("s"), deal(a, x).alias("deal"))))
        return F.struct(F.zip_with(a["open"], F.element_at(out, -1)["deal"], lambda o, d: o - d).alias("open"), out.alias("out"))

    dealt = plan.select("order", F.explode(F.aggregate("strata", F.struct(F.col("open"), none.alias("out")), step, lambda a: a["out"])).alias("d"))
    upto = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.aggregate(F.slice("d.deal", F.lit(1), i), F.lit(0).cast("long"), lambda t, n: t + n))
    dealt = dealt.select(F.col("d.s").alias(stratum), "order", upto.alias("__upto"))
    r = ranked(games, [stratum], game, "folds", seed, "__place").join(dealt, stratum)
    fold = F.get("order", F.size(F.filter("__upto", lambda u: u < F.col("__place"))))
    return r.withColumn("fold", fold).select(*games.columns, "fold")


def validation_sample(games: DataFrame, by: list[str], game: str, stratum: str, fraction: float, seed: int) -> DataFrame:
    """Adds ``validation`` to each cell's training games (DES-12): ceil(fraction * games) of them, one at least and one less than all at most, over the strata by
    largest remainders, within a stratum by rank. Games are whole: rows follow their game. A cell with one game has none."""
    once = games.select(*by, game, stratum).distinct()
    caps = once.groupBy(*by, stratum).agg(F.count("*").alias("__capacity"))
    whole = F.sum("__capacity").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    want = F.least(F.greatest(F.ceil(whole * F.lit(fraction) - 1e-9), F.lit(1)), whole - 1)
    plan = largest_remainder(caps.withColumn("__want", want), by, stratum, "__capacity", F.col("__want")).select(*by, stratum, "allocation")
    place = ranked(once, [*by, stratum], game, "validation", seed, "__place").join(plan, [*by, stratum])
    return place.withColumn("validation", F.col("__place") <= F.col("allocation")).select(*by, game, stratum, "validation")


def cells(repeats: int, models: list[str], anchors: list[int], spark) -> DataFrame:
    """The grid repeat x model x n_train (DES-13)."""
    base = spark.range(1, repeats + 1).select(F.col("id").cast("int").alias("repeat"))
    return base.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).withColumn("n_train", F.explode(F.array(*[F.lit(a) for a in anchors])))


def fingerprint(splits: DataFrame, by: list[str], game: str) -> DataFrame:
    """SHA-256 of the sorted games of each group (DES-14)."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col(game).cast("string"))), ",")
    return splits.groupBy(*by).agg(F.sha2(ids.cast("binary"), 256).alias("fingerprint"), F.count("*").alias("n_games"))


def split_violations(splits: DataFrame, game: str) -> DataFrame:
    """Games with more than one role in a repeat (SET-5)."""
    return splits.where("role is not null").groupBy("repeat", game).agg(F.countDistinct("role").alias("n_roles")).where("n_roles > 1")


def nesting_violations(anchors: DataFrame, by: list[str], game: str) -> DataFrame:
    """Games of one anchor that the next larger anchor lacks: ``by, game, n_train, missing_at`` (SET-5)."""
    sizes = anchors.select("n_train").distinct()
    following = sizes.withColumn("missing_at", F.lead("n_train").over(Window.orderBy("n_train"))).where("missing_at is not null")  # a handful of sizes
    asked = anchors.select(*by, game, "n_train").join(F.broadcast(following), "n_train")
    there = anchors.select(*by, game, F.col("n_train").alias("missing_at"))
    return asked.join(there, [*by, game, "missing_at"], "left_anti")


def inner_splits(train: DataFrame, by: list[str], game: str, stratum: str, parts: dict[str, int], denominator: int, seed: int) -> DataFrame:
    """Adds ``part`` to the training games of each group ``by`` (DES-11): of each group's games ``parts[name]`` /
    ``denominator`` (rounded up) go to each part, by largest remainders over strata and by hash rank within them, the rest stays
    ``fit``. One group is one anchor of one repeat, so parts never cross anchors."""
    caps = train.groupBy(*by, stratum).agg(F.count("*").alias("__c"))
    total = F.sum("__c").over(Window.partitionBy(*by))
    share, names = caps, list(parts)
    for name in names:
        wanted = F.ceil(total * parts[name] / denominator).cast("long")
        share = share.withColumn("__want", wanted)
        share = largest_remainder(share, by, stratum, "__c", F.col("__want")).withColumnRenamed("allocation", f"__{name}").drop("__want")
    r = ranked(train, [*by, stratum], game, "inner", seed, "__place").join(share, [*by, stratum])
    part, upto = F.lit("fit"), F.lit(0)
    edges = []
    for name in names:
        edges.append((name, upto, upto + F.col(f"__{name}")))
        upto = upto + F.col(f"__{name}")
    for name, lo, hi in reversed(edges):
        part = F.when((F.col("__place") > lo) & (F.col("__place") <= hi), name).otherwise(part)
    return r.withColumn("part", part).select(*train.columns, "part")
