"""Cohort rules: labels, exclusions and layout contracts of prediction questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.operators import contract


def outcome_label(df: DataFrame, outcome: str, eligible: list[str], positive: str) -> DataFrame:
    """Rows with an eligible outcome and ``label``: 1 where it is the positive one (PRJ-1, PRJ-3, PRJ-7)."""
    return df.where(F.col(outcome).isin(*eligible)).withColumn("label", (F.col(outcome) == positive).cast("int"))


def made_missed(df: DataFrame, made: Column, missed: Column) -> DataFrame:
    """``label`` 1 where made, 0 where missed and not made; other rows go (PRJ-4)."""
    label = F.when(F.coalesce(made, F.lit(False)), 1).when(F.coalesce(missed, F.lit(False)), 0)
    return df.withColumn("label", label).where("label is not null")


def candidate_labels(df: DataFrame, keys: list[str], made: Column, missed: Column) -> tuple[DataFrame, DataFrame]:
    """made_missed() by candidate, and the violations (rule, key) of candidates with several records (PRJ-4): repeated. Those have no
    label: of the labels only candidates with one record are returned."""
    wrong = contract.repeated(df, keys)
    once = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return made_missed(df.join(once, keys, "left_semi"), made, missed), wrong


def no_penalty(foul: Column, nullified: Column) -> Column:
    """Foul null, empty or NA, and the play not nullified; a null flag counts as not nullified (PRJ-5)."""
    return (foul.isNull() | F.trim(foul).isin("", "NA")) & (F.coalesce(F.upper(F.trim(nullified)), F.lit("")) != "Y")


def is_run(result: Column) -> Column:
    """No pass result, an empty one, NA, or R (PRJ-6)."""
    return result.isNull() | F.upper(F.trim(result)).isin("", "NA", "R")


def bounded_target(df: DataFrame, target: str, low: int, high: int) -> DataFrame:
    """Rows with a target; one outside the support is an error when it is read (PRJ-2)."""
    ok = F.col(target).between(low, high)
    return df.where(F.col(target).isNotNull()).withColumn(target, F.when(ok, F.col(target)).otherwise(F.raise_error(F.lit(f"{target} outside {low}..{high}")).cast("int")))


def support_index(value: Column, low: int, high: int) -> Column:
    """Zero-based index of a value clipped to low..high (PRJ-9, PRJ-10)."""
    return F.greatest(F.least(value, F.lit(high)), F.lit(low)) - low


def key_mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with ``side`` (PRJ-8, JN-9)."""
    a, c = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(c, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(c.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns, absent ones as typed nulls (PRJ-12)."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def snapshot_violations(df: DataFrame, play: str, obj: str, side: str, focal: Column, rows: int, constant: list[str]) -> DataFrame:
    """Plays that break a snapshot's structure, with what they break: row count, distinct objects, one focal row, even
    sides, columns constant within the play (PRJ-16)."""
    other = F.when(F.col(side) != "home", F.col(side))
    ends = {"side": other, **{f"c_{c}": F.col(c) for c in constant}}
    each = df.repartition(play).groupBy(play, obj).agg(  # dealt by play first: counts of objects, of which few repeat, would shorten nothing before
        F.count("*").alias("n"), F.count_if(focal).alias("focal"), F.count_if(F.col(side) == "home").alias("home"), *[f(c).alias(f"{n}_{f.__name__}") for n, c in ends.items() for f in (F.min, F.max)]
    )
    s = each.groupBy(play).agg(
        F.sum("n").alias("n"), F.count(obj).alias("objects"), F.sum("focal").alias("focal"), F.sum("home").alias("home"), *[(F.min(f"{n}_min") == F.max(f"{n}_max")).alias(f"one_{n}") for n in ends]
    )
    broken = {
        "rows": F.col("n") != rows, "objects": F.col("objects") != rows, "focal": F.col("focal") != 1, "sides": ~F.coalesce("one_side", F.lit(False)) | (F.col("home") * 2 != rows),
        **{f"constant_{c}": ~F.col(f"one_c_{c}") for c in constant},
    }
    problems = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in broken.items()]))
    return s.select(play, problems.alias("problems")).where(F.size("problems") > 0)


def band_counts(df: DataFrame, band: Column, label: str, expected: DataFrame) -> DataFrame:
    """Counts by band and label beside expected ones, and whether they agree (PRJ-17)."""
    got = df.groupBy(band.alias("band"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return got.join(expected, ["band", "label"], "full_outer").withColumn("agrees", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)))


def mask_layout(rows: DataFrame, play: str, time: str, first: int, last: int) -> DataFrame:
    """How each play's observed times lie in first..last: all, gaps, right, left or inside (SET-8)."""
    f = rows.groupBy(play).agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.countDistinct(time).alias("n"))
    layout = (
        F.when(F.col("n") == last - first + 1, "all").when(F.col("hi") - F.col("lo") + 1 != F.col("n"), "gaps").when(F.col("hi") == last, "right").when(F.col("lo") == first, "left").otherwise("inside")
    )
    return f.select(play, layout.alias("layout"))
