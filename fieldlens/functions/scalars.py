"""Scalar column functions: clocks, identifiers, angles, probability vectors, hashes and seeds.

Every function takes and returns Columns and stays inside Catalyst. Null in gives null out unless stated.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(value: Column) -> Column:
    """``MM:SS`` or ``MM:SS:xx`` as seconds; a single number passes through; anything else is null (FN-1)."""
    parts = F.split(F.trim(value.cast("string")), ":")
    minutes, seconds = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 1, minutes).when(F.size(parts) <= 3, minutes * 60 + seconds)


def first_integer(value: Column) -> Column:
    """The first run of digits inside a string, as long: ``20;21`` -> 20 (FN-2)."""
    return F.regexp_extract(value.cast("string"), r"(\d+)", 1).try_cast("long")


def lookup(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Map of upper-cased, trimmed keys to labels; unmapped keys become ``default`` (FN-3, FN-8)."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, F.upper(F.trim(value)))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def side_name(side: Column, home: Column, away: Column) -> Column:
    """``home``/``away`` in any case as the team's name; other values pass through (FN-4)."""
    low = F.lower(side)
    return F.when(low == "home", home).when(low == "away", away).otherwise(side)


def other_side(team: Column, home: Column, away: Column) -> Column:
    """The opponent of ``team`` in a game; null where the team is neither side (FN-7)."""
    return F.when(team == home, away).when(team == away, home)


def feet_inches(value: Column) -> Column:
    """``6-2`` as 74 inches; null where the text has another form (FN-5)."""
    feet, inches = (F.regexp_extract(value, r"^\s*(\d+)\s*-\s*(\d+)\s*$", i).try_cast("int") for i in (1, 2))
    return 12 * feet + inches


def loose_boolean(value: Column) -> Column:
    """True for true, 1 and 1.0 in any case; null counts as false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "1.0"), F.lit(False))


def sentinel_number(value: Column) -> Column:
    """A number from text in which empty or ``NA`` means null (SRC-8)."""
    text = F.trim(value.cast("string"))
    return F.when((text != "") & (F.upper(text) != "NA"), text.try_cast("double"))


def angle_components(theta: Column, mirror: Column) -> tuple[Column, Column]:
    """(sin, cos) of a compass angle in degrees as ``(90 - theta) mod 360``, both negated where mirrored; a null
    angle gives (0, 0) (FN-6)."""
    rad = F.radians(F.pmod(F.lit(90.0) - theta, F.lit(360.0)))
    sign = F.when(mirror, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.coalesce(F.sin(rad) * sign, F.lit(0.0)), F.coalesce(F.cos(rad) * sign, F.lit(0.0))


def yards_from_own_goal(yard_line: Column, own_side: Column, middle: int = 50, length: int = 100) -> Column:
    """Distance from a side's own goal line (FN-9)."""
    return F.when(yard_line == middle, F.lit(middle)).when(own_side, yard_line).otherwise(F.lit(length) - yard_line)


def score_columns(home_offense: Column, home: Column, visitor: Column) -> tuple[Column, Column, Column]:
    """The offense's score, the defense's, and how far the offense leads (FN-9)."""
    offense, defense = F.when(home_offense, home).otherwise(visitor), F.when(home_offense, visitor).otherwise(home)
    return offense, defense, offense - defense


# -- probability vectors -------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside lambdas over arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def moments(values: Column, item: Callable[[Column], Column] = lambda x: x) -> Column:
    """Struct (n, mean, m2) of ``item`` of an array's elements, m2 the sum of squares about the mean, in one pass."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a: Column, x: Column) -> Column:
        n, away = a["n"] + 1, item(x) - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + away / n).alias("mean"), (a["m2"] + away * away * a["n"] / n).alias("m2"))

    return F.aggregate(values, start, step)


def renormalized(pmf: Column, floor: float | None = None) -> Column:
    """A probability vector that sums to one, its entries first raised to ``floor`` where given (FN-10)."""
    p = F.transform(pmf, lambda x: F.greatest(x, F.lit(floor))) if floor is not None else pmf
    return let(p, lambda q: let(total(q), lambda t: F.transform(q, lambda x: x / t)))


def valid_pmf(pmf: Column, classes: int, tolerance: float = 1e-7) -> Column:
    """Whether a vector has the right length, no negative or missing entry, and sums to one (FN-10)."""
    fine = F.forall(pmf, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0))
    return (F.size(pmf) == classes) & fine & (F.abs(total(pmf) - 1) <= tolerance)


def cumulative(pmf: Column) -> Column:
    """Running sums of a vector (FN-11)."""
    empty = F.array().cast("array<double>")
    step = lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x))
    return F.aggregate(pmf, empty, step)


def pmf_mean(pmf: Column, first: int = 0) -> Column:
    return F.aggregate(F.transform(pmf, lambda p, i: p * (i + first)), F.lit(0.0), lambda a, x: a + x)


def pmf_sd(pmf: Column, first: int = 0) -> Column:
    squares = lambda m: F.aggregate(F.transform(pmf, lambda p, i: p * (i + first - m) * (i + first - m)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(let(pmf_mean(pmf, first), squares))


def pmf_entropy(pmf: Column) -> Column:
    """-sum p ln p, with 0 ln 0 = 0 (FN-12)."""
    return F.aggregate(F.transform(pmf, lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def clipped(p: Column, eps: float = 1e-12) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def bernoulli_entropy(p: Column) -> Column:
    q = clipped(p)
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def skill(loss: Column, null_loss: Column) -> Column:
    """1 - loss / null loss; null where the null loss isn't positive (FN-14, FN-22)."""
    return F.when(null_loss > 0, 1 - loss / null_loss)


def weighted_quantile(pairs: Column, q: Column) -> Column:
    """From an array of structs (value, weight): the least value whose running weight reaches q of the total
    (FN-19)."""
    ordered = F.array_sort(pairs)
    goal = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["weight"]) * q
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("v"))

    def step(a: Column, x: Column) -> Column:
        w = a["w"] + x["weight"]
        reached = a["v"].isNull() & (w >= goal - 1e-12)
        return F.struct(w.alias("w"), F.when(reached, x["value"]).otherwise(a["v"]).alias("v"))

    return F.aggregate(ordered, start, step, lambda a: F.coalesce(a["v"], F.array_max(F.transform(ordered, lambda x: x["value"]))))


def pooled(points: Column) -> Column:
    """Isotonic fit of an array of structs (w, wy), weights and weighted values in order of x: array of fitted values.
    Blocks are kept latest first; a new one takes in those before it whose mean isn't below its own."""
    block = lambda w, wy, n: F.struct(w.alias("w"), wy.alias("wy"), n.alias("n"))
    none = F.array().cast("array<struct<w:double,wy:double,n:int>>")

    def push(blocks: Column, x: Column) -> Column:
        start = F.struct(block(x["w"].cast("double"), x["wy"].cast("double"), F.lit(1)).alias("now"), none.alias("rest"))

        def merge(a: Column, b: Column) -> Column:
            now = a["now"]
            takes = (F.size(a["rest"]) == 0) & (b["wy"] * now["w"] >= now["wy"] * b["w"])
            return F.struct(
                F.when(takes, block(now["w"] + b["w"], now["wy"] + b["wy"], now["n"] + b["n"])).otherwise(now).alias("now"),
                F.when(takes, a["rest"]).otherwise(F.concat(a["rest"], F.array(b))).alias("rest"),
            )

        return F.aggregate(blocks, start, merge, lambda a: F.concat(F.array(a["now"]), a["rest"]))

    blocks = F.aggregate(points, none, push)
    return F.flatten(F.transform(F.reverse(blocks), lambda b: F.array_repeat(b["wy"] / b["w"], b["n"])))


# -- hashes --------------------------------------------------------------------------------------------------


def sha_number(text: Column, modulus: Column | int) -> Column:
    """The first 64 bits of SHA-256 of ``text``, modulo ``modulus``, as long (WIN-18)."""
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    number = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % m.cast("decimal(20,0)")).cast("long")


def hashed_bucket(column: str, value: Column, buckets: int = 8) -> Column:
    """Stable bucket of ``column NUL value`` (FN-15)."""
    return sha_number(F.concat(F.lit(column + "\0"), F.coalesce(value.cast("string"), F.lit(""))), buckets)


def stable_seed(key: Column, secret: str = "fieldlens") -> Column:
    """31-bit seed: HMAC-SHA256 of a key under a secret, from nested digests over the padded key (FN-16)."""
    pad = secret.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in pad), bytes(b ^ 0x5C for b in pad)
    first = F.sha2(F.concat(F.lit(inner), key.cast("binary")), 256)
    mac = F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)
    return (F.conv(F.substring(mac, 1, 8), 16, 10).cast("long") % F.lit(1 << 31)).cast("long")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of the fields in the order of their names (FN-17)."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def metric_scope(name: Column) -> tuple[Column, Column]:
    """(base, scope) of a metric name: ``game_equal_x`` and ``x_game_equal`` -> (x, game), ``play_x`` -> (x, play),
    others -> (x, overall) (FN-18)."""
    base = F.regexp_replace(name, r"^(game_equal_|play_)|_game_equal$", "")
    scope = F.when(name.rlike("^game_equal_|_game_equal$"), "game").when(name.rlike("^play_"), "play").otherwise("overall")
    return base, scope


def normal_tail(x: Column) -> Column:
    """Share of the standard normal above x >= 0: a power series up to 2, above that the continued fraction of the tail (FN-21)."""
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)

    def series(v: Column) -> Column:
        start = F.struct(v.alias("term"), v.alias("sum"))
        more = lambda s, k: let(s["term"] * v * v / (2 * k + 1), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, more, lambda s: s["sum"])

    below = 0.5 - density * let(F.least(x, F.lit(2.0)), series)
    rest = let(F.greatest(x, F.lit(2.0)), lambda v: v + F.aggregate(F.sequence(F.lit(100), F.lit(1)), F.lit(0.0), lambda r, k: k / (v + r)))
    return F.when(x <= 2, below).otherwise(density / rest)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, within 1e-14 (FN-21)."""
    return let(z.cast("double"), lambda v: F.when(v >= 0, 1 - normal_tail(F.abs(v))).otherwise(normal_tail(F.abs(v))))


def normal_quantiles(p: Column) -> Column:
    """Standard normal quantile within 1e-11: a rational start and three Halley steps on the nearer tail; null outside (0, 1) (FN-21)."""

    def upper(q: Column) -> Column:
        t = F.sqrt(-2 * F.log(q))
        x = F.greatest(t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t), F.lit(0.0))
        for _ in range(3):
            step = lambda v: let((q - normal_tail(v)) * math.sqrt(2 * math.pi) * F.exp(v * v / 2), lambda u: F.greatest(v - u / (1 + v * u / 2), F.lit(0.0)))
            x = let(x, step)
        return x

    inside = (p > 0) & (p < 1)
    return F.when(inside & (p < 0.5), -let(F.least(p, F.lit(0.5)), upper)).when(inside, let(F.least(1 - p, F.lit(0.5)), upper))


def t_cdf(t: Column, df: Column) -> Column:
    """Student's distribution function for whole degrees of freedom: the finite sum in the angle whose tangent is |t| / sqrt(df) (FN-20)."""

    def inside(v: Column) -> Column:
        n = df.cast("int")
        c2, s = n / (n + v * v), F.abs(v) / F.sqrt(n + v * v)
        odd = n % 2 == 1
        terms = F.when(odd, (n - 3) / 2).otherwise((n - 2) / 2).cast("int")

        def sums(c: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
            ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
            more = lambda a, k: let(F.when(k <= terms, a["term"] * c * ratio(k)).otherwise(0.0), lambda x: F.struct(x.alias("term"), (a["sum"] + x).alias("sum")))
            return F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, more, lambda a: a["sum"])

        whole = let(c2, sums)
        angle = F.atan(F.abs(v) / F.sqrt(n))
        both = F.when(odd, 2 / math.pi * (angle + F.when(n > 1, s * F.sqrt(c2) * whole).otherwise(0.0))).otherwise(s * whole)
        return 0.5 + F.signum(v) * both / 2

    return let(t.cast("double"), inside)


def _expanded(z, df):
    """Student quantile from the normal one, to the fourth order in 1 / df."""
    return (
        z
        + (z**3 + z) / (4 * df)
        + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * df**4)
    )


#: Degrees of freedom up to which Student quantiles are exact; beyond, the expansion is within 1e-10 between 0.0005 and 0.9995.
EXACT_DF = 300


def t_quantiles(p: Column, df: Column) -> Column:
    """Student quantile for whole degrees of freedom: up to EXACT_DF by bisection of t_cdf(), beyond by
    the expansion; null outside (0, 1) (FN-20)."""

    def exact(q: Column) -> Column:
        # the upper half: x in [0, 1] stands for t = tan(x * pi / 2) * sqrt(df), so the bracket is finite
        value = lambda x: t_cdf(F.tan(x * (math.pi / 2)) * F.sqrt(df), df)
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        halved = lambda s, _: let((s["lo"] + s["hi"]) / 2, lambda m: F.when(value(m) < q, F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(53)), start, halved, lambda s: F.tan((s["lo"] + s["hi"]) / 2 * (math.pi / 2)) * F.sqrt(df))

    upper = F.greatest(p, 1 - p)
    found = F.when(p == 0.5, F.lit(0.0)).when(df <= EXACT_DF, let(upper, exact)).otherwise(let(normal_quantiles(upper), lambda z: _expanded(z, df)))
    return F.when((p > 0) & (p < 1) & (df >= 1), F.when(p < 0.5, -found).otherwise(found))


def normal_quantile(p: float) -> float:
    """Quantile of the standard normal, for literals (FN-21)."""
    return NormalDist().inv_cdf(p)


def t_probability(t: float, df: int) -> float:
    """t_cdf() of one number."""
    c2, odd = df / (df + t * t), df % 2
    total = term = 1.0
    for k in range(1, (df - 3) // 2 + 1 if odd else (df - 2) // 2 + 1):
        term *= c2 * (2 * k / (2 * k + 1) if odd else (2 * k - 1) / (2 * k))
        total += term
    sine = abs(t) / math.sqrt(df + t * t)
    both = 2 / math.pi * (math.atan(abs(t) / math.sqrt(df)) + (sine * math.sqrt(c2) * total if df > 1 else 0.0)) if odd else sine * total
    return 0.5 + math.copysign(both, t) / 2


def t_critical(confidence: float, df: int, two_sided: bool = True) -> float:
    """Student-t critical value (FN-20): the exact quantile up to EXACT_DF, beyond that its expansion."""
    p = 1 - (1 - confidence) / 2 if two_sided else confidence
    if df > EXACT_DF:
        return _expanded(normal_quantile(p), df)
    lo, hi = -1.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_probability(math.tan(mid * math.pi / 2) * math.sqrt(df), df) < p else (lo, mid)
    return math.tan((lo + hi) / 2 * math.pi / 2) * math.sqrt(df)
