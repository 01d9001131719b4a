"""Rules that tables must keep: every rule is a named condition, broken rules are counted with their least keys, and the caller
chooses between a report and an error.

Violations are long, ``rule, key`` with one row for each broken row or group. Rules over the same rows are tested in one pass over them; only
violations are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offending keys that a report names.
NAMED = 3


class ContractError(ValueError):
    """A table breaks its contract."""


def _text(keys: list[str]) -> Column:
    return F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])


def _broken(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    named = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return df.select(F.explode(named).alias("rule"), _text(keys).alias("key"))


def broken_rows(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """``rule, key`` of the rows for which a rule's condition holds; a condition that is null doesn't hold."""
    return _broken(df, keys, rules)


def broken_groups(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """``rule, key`` of the groups by ``keys`` for which an aggregate condition holds. All rules share one aggregation."""
    bad = df.groupBy(*keys).agg(*[F.coalesce(rule, F.lit(False)).alias(f"__bad_{i}") for i, rule in enumerate(rules.values())])
    return _broken(bad, keys, {name: F.col(f"__bad_{i}") for i, name in enumerate(rules)})


def repeated(df: DataFrame, keys: list[str], rule: str = "repeated") -> DataFrame:
    """Keys that several rows have."""
    return broken_groups(df, keys, {rule: F.count("*") > 1})


def not_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that two tables don't have exactly once each: repeated_left, repeated_right, missing_left, missing_right."""
    a = left.groupBy(*keys).agg(F.count("*").alias("__a"))
    b = right.groupBy(*keys).agg(F.count("*").alias("__b"))
    same = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])  # null keys are keys
    both = a.alias("l").join(b.alias("r"), same, "full_outer").select(*[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys], "__a", "__b")
    n_a, n_b = F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0))
    return _broken(both, keys, {"repeated_left": n_a > 1, "repeated_right": n_b > 1, "missing_left": n_a == 0, "missing_right": n_b == 0})


def absent(df: DataFrame, other: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys of ``df`` that ``other`` doesn't have."""
    gone = df.select(*keys).distinct().join(other.select(*keys).distinct(), keys, "left_anti")
    return gone.select(F.lit(rule).alias("rule"), _text(keys).alias("key"))


def not_finite(column: str, missing_is_fine: bool = False) -> Column:
    value = F.col(column).try_cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return bad & F.col(column).isNotNull() if missing_is_fine else bad


def not_whole(column: str) -> Column:
    value = F.col(column).try_cast("double")
    return value.isNull() | (value != F.floor(value))


def outside(column: str, domain: list) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*domain)


def report(violations: DataFrame, rules: list[str]) -> DataFrame:
    """``rule, n, first``: how many rows or groups break each of ``rules``, and the NAMED least keys. Rules that hold have 0 and no keys.
    Violations are read once, and a task passes on one row a rule, which it counts and whose least keys it keeps."""
    spark, named = violations.sparkSession, NAMED

    def least(keys: pa.Array) -> pa.Array:
        keys = keys.drop_null().unique()
        return keys.take(pc.sort_indices(keys)[:named])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first = Counter(), {}
        for batch in batches:
            rule, key = batch.column(0), batch.column(1)
            for name in rule.unique():
                own = key.filter(pc.equal(rule, name)) if name.is_valid else key.slice(0, 0)
                r, keys = name.as_py(), least(own)
                counts[r] += len(own)
                first[r] = least(pa.concat_arrays([first[r], keys])) if r in first else keys
        if counts:
            rows = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([first[r].to_pylist() for r in counts], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(rows, ["rule", "n", "keys"])

    parts = violations.select(F.col("rule").cast("string"), F.col("key").cast("string")).mapInArrow(told, "rule string, n bigint, keys array<string>")
    found = parts.groupBy("rule").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))), 1, named).alias("first"))
    every = spark.createDataFrame([(r,) for r in dict.fromkeys(rules)], "rule string")
    out = every.join(found, "rule", "left")
    return out.select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("first", F.array().cast("array<string>")).alias("first"))


def enforce(violations: DataFrame) -> None:
    """A ContractError that names the broken rules, how often, and their first keys, if there are any."""
    counts = violations.groupBy("rule").agg(F.count("*").alias("n"))
    broken = [r.rule for r in counts.select("rule").orderBy("rule").collect()]  # one row a rule
    if broken:
        lines = [f"{r.rule}: {r.n} ({', '.join(r.first)})" for r in report(violations, broken).orderBy("rule").collect()]
        raise ContractError("; ".join(lines))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- contracts of the study's tables ----------------------------------------------------------------------------------


def snapshot_contract(
    rows: DataFrame, play: list[str], obj: str, focal: str, side: str, sides: list[str], constant: list[str], finite: list[str], finite_if_there: list[str], whole: list[str], domains: dict[str, list], size: int
) -> DataFrame:
    """Violations of a snapshot's structure (PRJ-16): numbers finite and whole, domains, ``size`` rows and objects a play, one focal object,
    as many rows on its side as on the other, columns constant within a play (null is a value)."""
    by_row = {f"{c}_finite": not_finite(c) for c in finite} | {f"{c}_finite_if_there": not_finite(c, True) for c in finite_if_there}
    by_row |= {f"{c}_whole": not_whole(c) for c in whole} | {f"{c}_domain": outside(c, d) for c, d in (domains | {side: sides}).items()}
    is_focal = F.coalesce(F.col(obj) == F.col(focal), F.lit(False))
    on_side = F.max(F.when(is_focal, F.col(side)))
    counts = [F.count_if(F.col(side) == s) for s in sides]
    own = reduce(lambda a, b: F.coalesce(a, b), [F.when(on_side == s, n) for s, n in zip(sides, counts)])
    varied = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False)) | F.count(c).between(1, F.count("*") - 1)
    once = F.row_number().over(Window.partitionBy(*play, obj).orderBy(obj)) == 1  # countDistinct would deal every row out once for each column
    objects = F.count_if(F.col("__once") & F.col(obj).isNotNull())
    by_play = {"rows": F.count("*") != size, "objects": objects != size, "focal": F.count_if(is_focal) != 1, "sides": F.coalesce(own, F.lit(-1)) * 2 != size}
    by_play |= {f"{c}_constant": varied(c) for c in constant}
    return broken_rows(rows, [*play, obj], by_row).unionByName(broken_groups(rows.withColumn("__once", once), play, by_play))


def dataset_contract(
    examples: DataFrame, tokens: DataFrame, frames: DataFrame, example: str, time: str, label: str, support: list[float], channels: list[str], order: list[str], steps: int
) -> DataFrame:
    """Violations of a prepared dataset (SET-8): ``examples`` unique, labels in 0..len(support) - 1; ``support`` increasing; ``tokens`` finite, of known
    examples, only at observed ``frames`` (example, time); the feature columns in ``order``; the frames of an example without gaps, at one end of
    0..steps - 1."""
    spark = examples.sparkSession
    parts = [
        repeated(examples, [example], "example_repeated"),
        broken_rows(examples, [example], {"label_support": outside(label, list(range(len(support))))}),
        broken_rows(tokens, [example, time], {f"{c}_finite": not_finite(c) for c in channels}),
        absent(tokens, frames, [example, time], "token_without_frame"),
        absent(frames, examples, [example], "frame_without_example"),
        broken_rows(frames, [example, time], {"time_range": ~F.col(time).between(0, steps - 1)}),
        broken_groups(frames, [example], {"frame_gaps": F.max(time) - F.min(time) + 1 != F.countDistinct(time), "frame_padding": (F.min(time) > 0) & (F.max(time) < steps - 1)}),
    ]
    whole = [("support_increasing", str(i)) for i in range(1, len(support)) if support[i] <= support[i - 1]]
    whole += [("feature_order", ",".join(tokens.columns))] if [c for c in tokens.columns if c in order] != order else []
    return union([*parts, spark.createDataFrame(whole, "rule string, key string")])
