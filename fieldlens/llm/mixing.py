"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm._spark import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights that the sources take in turn, by code point of their names.
WEIGHTS = (5.0, 2.0, 1.0)
#: Slices of the sampling order; only the slice where a target falls is sorted row by row.
SLICES = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes(source, source_size)`` -> plus ``weight, target``.

    The targets share ``share`` times all sizes by weight; none exceeds ``most`` times its source's size, and
    what exceeds it is shared again. With sources ordered by cap / weight, those that are full form a prefix,
    so the level follows from running sums over the (already aggregated) sources.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn(
        "level",
        (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    ).withColumn("place", F.row_number().over(by))
    open_ = F.col("level") <= F.col("ratio")
    level = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("place"))).over(everything)
    return s.select("source", "source_size", "weight", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")).alias("target"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that the id and the seed fix."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix_sources(
    docs: DataFrame, seed: str = "mix:", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, row: Column | None = None
) -> DataFrame:
    """How often a mix takes each row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken, chance, rid``.

    size is the number of words. Each source's target comes from source_targets(). Every document is first
    taken floor(target / source_size) whole times. The rest of the target is a Pareto sample whose size is fixed in
    words. ``chance`` is a document's inclusion probability in it: proportional to the root of its size, those that
    reach 1 being certain, and the others raised until the expected words are the rest. With u a document's uniform number, documents
    come in order of odds(u) / odds(chance), certain ones first, and are taken as long as their words fit; one further
    document, the one whose size is nearest to the words still missing, is taken where that brings the source
    nearer. Reruns give the same mix.

    The probabilities follow from counts by source and size. The order is cut into SLICES ranges whose sizes are
    pre-aggregated, so a source with most of the rows is
    neither sorted nor summed in one task; only the range that holds the target's end is.

    Null or empty texts have size 0: they get their source's whole copies and count no word. A null source is a source of its own, last in
    order. A null doc_id draws the number of the empty text. Repeated rows count and are taken each on its
    own. An empty table gives an empty result. Other columns of docs are not read.
    """
    id_, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    sized = docs.select(
        id_.alias("doc_id"), source.alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.monotonically_increasing_id() if row is None else row).alias("rid"),
    )
    sized = cut(sized, "sized")

    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = targets.join(chances(sized, targets), F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    plan = cut(plan.withColumnRenamed("source", "p_source"), "targets")

    u = uniform(F.col("doc_id"), seed)
    chance = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.least(F.lit(1.0), F.col("level") * F.sqrt(F.col("size").cast("double"))))
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source").withColumn("chance", chance).drop("level")
    q = F.when(F.col("chance") > 0, (u / (1 - u)) * (1 - F.col("chance")) / F.col("chance"))
    rows = rows.withColumn("q", q).withColumn("slice", F.floor(F.col("q") / (1 + F.col("q")) * SLICES).cast("int"))
    rows = cut(rows, "ordered")

    parts = rows.where("q is not null").groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    parts = parts.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("slice")))
    ends = parts.where("upto > rest").groupBy("source").agg(F.min("slice").alias("end_slice"), F.min_by(F.col("upto") - F.col("words"), "slice").alias("before"))
    ends = cut(ends.withColumnRenamed("source", "e_source"), "ends")

    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size", "rid")
    inside = F.col("slice") == F.col("end_slice")
    edge = rows.where(inside).withColumn("fits", F.col("before") + F.sum("size").over(order) <= F.col("rest"))
    others = rows.where(~F.coalesce(inside, F.lit(False)))
    others = others.withColumn("fits", F.col("q").isNotNull() & F.coalesce(F.col("slice") < F.col("end_slice"), F.lit(True)))
    drawn = cut(edge.unionByName(others), "drawn")

    got = drawn.groupBy("source").agg(F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("got"), F.first("rest").alias("rest"))
    gap = cut(got.select(F.col("source").alias("g_source"), (F.col("rest") - F.col("got")).alias("gap")), "gaps")
    loose = drawn.where("not fits and q is not null").join(gap, F.col("source").eqNullSafe(F.col("g_source")))
    away = F.abs(F.col("size") - F.col("gap"))
    filler = loose.where(away < F.col("gap")).groupBy("g_source").agg(F.min(F.struct(away.alias("away"), "q", "doc_id", "size", "rid")).alias("f"))
    filler = cut(filler.select(F.col("f.rid").alias("rid"), F.lit(1).alias("fill")), "fillers")
    out = drawn.join(filler, "rid", "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("fits").cast("int") + F.coalesce("fill", F.lit(0))).otherwise(F.col("whole")).cast("int")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "chance", "rid")


def chances(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``c_source, level``: the factor with which the roots of the sizes, at most 1 each, become probabilities whose expected words
    are the source's rest. Sizes from the largest down are certain until the next one isn't."""
    counts = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    named = targets.select(F.col("source").alias("c_source"), "rest")
    counts = counts.join(named, F.col("source").eqNullSafe(F.col("c_source"))).drop("source")
    larger = Window.partitionBy("c_source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    certain = F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0))
    root = F.sqrt(F.col("size").cast("double"))
    open_ = F.sum(F.col("n") * F.col("size") * root).over(Window.partitionBy("c_source").orderBy("size"))
    counts = counts.withColumn("level", (F.col("rest") - certain) / open_)
    fair = F.when(F.col("level") * root < 1, F.struct("size", "level"))
    return counts.groupBy("c_source").agg(F.max(fair)["level"].alias("level"))


def take_mix(docs: DataFrame, seed: str = "mix:", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` that the mix takes at least once, with all columns, ``copies`` and ``taken``; see
    mix_sources(). Where docs has columns of these names, they stay and the new ones are ``mix_copies`` and ``mix_taken``.
    Rows are numbered in a written table, so repeated rows are told apart."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col("doc_id"), F.col("source"), F.col("text"), F.monotonically_increasing_id().alias("n"))
    rows = cut(rows.select("kept", F.col("n").alias("number")), "numbered")
    mix = mix_sources(rows.select("kept.doc_id", "kept.source", "kept.text", "number"), seed, weights, share, most, F.col("number")).where("copies > 0")
    out = rows.join(mix.select(F.col("rid").alias("number"), "copies", "taken"), "number")
    clash = {c.lower() for c in docs.columns} & {"copies", "taken"}
    names = ("mix_copies", "mix_taken") if clash else ("copies", "taken")
    return out.select("kept.*", F.col("copies").alias(names[0]), F.col("taken").alias(names[1]))
