"""Vectors and scores as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA_DAYS = 7.0
LOW, HIGH = 0.535, 0.660
#: Of embedding, tokens and time in a hybrid score.
WEIGHTS = (0.60, 0.25, 0.15)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero or lengths differ; null vectors count as empty."""
    norm = dot(a, a) * dot(b, b)
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / F.sqrt(norm)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(86_400_000_000.0)


def temporal(a: Column, b: Column, sigma: float = SIGMA_DAYS) -> Column:
    """A Gaussian of the distance in days; one half where a date is missing."""
    days = days_between(a, b)
    return F.coalesce(F.exp(-(days * days) / F.lit(2 * sigma * sigma)), F.lit(0.5))


def hybrid(embedding: Column, lexical: Column, time: Column) -> Column:
    return F.lit(WEIGHTS[0]) * embedding + F.lit(WEIGHTS[1]) * lexical + F.lit(WEIGHTS[2]) * time


def mean_vectors(df, keys: list[str], vector: str):
    """Element-wise mean per group: positions averaged with map-side combining, then put in order."""
    parts = df.select(*keys, F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(vector))


def running_mean(centroid: Column, vector: Column, n: Column) -> Column:
    """The mean of n vectors moved on by one more, kept in single precision."""
    moved = F.zip_with(centroid, vector, lambda c, v: ((c.cast("double") * n + v.cast("double")) / (n + 1)).cast("float"))
    return F.when(n < 1, F.transform(vector, lambda v: v.cast("float"))).otherwise(moved)


def valid(vector: Column, dimension: int) -> Column:
    return (F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


#: Different families that one story may hold.
COMPATIBLE = ("contract|transfer", "discipline|transfer", "competition|match", "discipline|match", "contract|staff", "finance|institutional")


def family_compatible(a: Column, b: Column) -> Column:
    a, b = F.coalesce(F.nullif(a, F.lit("")), F.lit("unknown")), F.coalesce(F.nullif(b, F.lit("")), F.lit("unknown"))
    pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return (a == b) | (a == "unknown") | (b == "unknown") | pair.isin(*COMPATIBLE)


def parse_vector(x: Column, dimension: int) -> Column:
    """A vector from comma-separated text; null unless every element is a finite number and the length is right."""
    parsed = F.transform(F.split(x, ","), lambda e: F.trim(e).try_cast("float"))
    return F.when(valid(parsed, dimension), parsed)


def decode_float32(blob: Column, dimension: int) -> Column:
    """Little-endian 32-bit floats from bytes; null where the length is wrong or a number is not finite."""
    # Eight hex digits a number, bytes turned round, then IEEE 754 by arithmetic: no Python for a fixed-width format.
    digits = F.hex(blob)

    def one(i: Column) -> Column:
        at = lambda k: F.substring(digits, (i * 8 + 1 + 2 * k).cast("int"), F.lit(2))
        bits = F.conv(F.concat(at(3), at(2), at(1), at(0)), 16, 10).cast("long")
        sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
        exponent, mantissa = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
        normal = (mantissa / float(1 << 23) + 1.0) * F.pow(F.lit(2.0), (exponent - 127).cast("double"))
        small = mantissa / float(1 << 23) * F.pow(F.lit(2.0), F.lit(-126.0))
        return F.when(exponent == 255, F.lit(None).cast("float")).otherwise((sign * F.when(exponent == 0, small).otherwise(normal)).cast("float"))

    values = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), one)
    return F.when((F.length(blob) == dimension * 4) & F.forall(values, lambda v: v.isNotNull()), values)


def hashed_embedding(tokens: Column, dimension: int = 64) -> Column:
    """A stand-in where no embedding model is at hand: signed counts of hashed tokens, of length one. Deterministic."""
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(dimension))
    sign = lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(tokens, lambda t: slot(t) == i), F.lit(0.0), lambda s, t: s + sign(t)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))


def clamp_int(x: Column, default: int, low: int, high: int) -> Column:
    """A whole number from text, the default where it is none, within bounds."""
    n = F.regexp_extract(F.coalesce(x, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.least(F.greatest(F.coalesce(n, F.lit(default)), F.lit(low)), F.lit(high))
