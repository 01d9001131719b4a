"""Secrets in texts, with weak candidates reported where complementary parts stand near; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm._spark import cut

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so a least length in the pattern drops just the runs that are too short.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts: a bare run of exactly 40 characters, and the host of a URL.
KEY = r"[A-Za-z0-9/+]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
LEAST_ASSIGN = 12
#: Shortest value of an assignment that counts as a weak part.
LEAST_WEAK = 8
#: Code points between the starts of parts that belong together.
SCOPE = 256
#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "weak", "key", "endpoint")


def _spans(kind: str, pattern: str, group: int | None = None) -> Column:
    """array<struct<s, e, g>> of the leftmost non-overlapping matches: code points, e exclusive, g the length of
    a group. The pieces between matches give the positions."""
    text, rx = F.col("text"), F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    inner = F.regexp_extract_all(text, rx, F.lit(group)) if group else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("m"), inner.alias("g"))
    empty = F.array().cast("array<struct<s:int,e:int,g:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), F.length(x["g"]).alias("g")))).alias("out"))

    parts = F.filter(parts, lambda x: x["m"].isNotNull())
    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(empty).alias(kind)


def _named(column: str, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(column, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def _listing(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, n_weak, base_spans, spans``.

    Strong spans (assign, access, hex) are always reported. Weak parts are assignments with a value of 8 to
    11 characters (``weak``), bare runs of exactly 40 characters that aren't hexadecimal (``key``) and hosts of
    URLs (``endpoint``). A weak or key part is reported where an access identifier or an endpoint starts within
    SCOPE code points of its start; an endpoint where both an access identifier and some secret do.

    The link is an interval join: parts are summed up by document, role and block of SCOPE code points to their
    first and last start, and a candidate looks into its own block and the two beside it. That is exact and
    gives three rows a candidate, however many parts a document has.

    Null text counts as empty: no spans. A null doc_id is kept. Repeated rows get equal results; rows that share
    a doc_id follow their own text. An empty table gives an empty result. Other columns are not read.
    """
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    doc = doc.select(
        "doc_id",
        F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text").alias("key_"),
        _spans("assign", ASSIGN, 2), _spans("access", ACCESS), _spans("hex", HEX), _spans("key", KEY), _spans("endpoint", ENDPOINT),
        F.regexp_extract_all("text", F.lit(KEY), F.lit(0)).alias("runs"),
    )
    hexes = F.transform("runs", lambda r: r.rlike("^[0-9a-f]+$"))
    keys = F.filter(F.arrays_zip(F.col("key"), hexes.alias("h")), lambda x: (x["key"]["g"] == 40) & ~x["h"])
    doc = doc.select(
        "doc_id", "key_",
        F.filter("assign", lambda x: x["g"] >= LEAST_ASSIGN).alias("assign"),
        "access", "hex",
        F.filter("assign", lambda x: (x["g"] < LEAST_ASSIGN) & (x["g"] >= LEAST_WEAK)).alias("weak"),
        F.transform(keys, lambda x: x["key"]).alias("key"),
        "endpoint",
    )
    doc = cut(doc, "parts")

    role = F.when(F.col("k") == 1, "I").when(F.col("k") == 5, "E").otherwise("S")
    some = doc.where((F.size("weak") > 0) | (F.size("key") > 0) | (F.size("endpoint") > 0))
    parts = some.select("key_", F.explode(F.concat(*[_named(k, k) for k in KINDS])).alias("x"))
    parts = parts.select("key_", "x.s", "x.k", "x.e").withColumn("block", F.floor(F.col("s") / SCOPE))

    def bound(name: str, r: str) -> list[Column]:
        here = F.when(role == r, F.col("s"))
        return [F.min(here).alias(f"{name}_lo"), F.max(here).alias(f"{name}_hi")]

    blocks = parts.groupBy("key_", "block").agg(*bound("i", "I"), *bound("t", "S"), *bound("p", "E"))
    weak = parts.where("k >= 3").distinct()
    look = weak.withColumn("look", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    blocks = blocks.withColumnRenamed("block", "look")
    seen = look.join(blocks, ["key_", "look"])

    def near(name: str) -> Column:
        lo, hi, s = F.col(f"{name}_lo"), F.col(f"{name}_hi"), F.col("s")
        close = F.when(F.col("look") == F.col("block"), lo.isNotNull()).when(F.col("look") < F.col("block"), s - hi <= SCOPE).otherwise(lo - s <= SCOPE)
        return F.coalesce(F.bool_or(close), F.lit(False)).alias(name)

    linked = seen.groupBy("key_", "s", "k", "e").agg(near("i"), near("t"), near("p"))
    linked = linked.where(F.when(F.col("k") == 5, F.col("i") & F.col("t")).otherwise(F.col("i") | F.col("p")))
    extra = linked.groupBy("key_").agg(F.collect_list(F.struct("s", "k", "e")).alias("extra"))
    out = doc.join(extra, "key_", "left")
    base = F.concat(*[_named(k, k) for k in KINDS[:3]])
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.size(F.coalesce("extra", none)).cast("long").alias("n_weak"),
        _listing(base).alias("base_spans"),
        _listing(F.concat(base, F.coalesce("extra", none))).alias("spans"),
    )
