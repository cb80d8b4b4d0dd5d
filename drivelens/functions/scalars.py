"""Scalar functions of columns, inside Spark's own expressions where these can say it."""

from __future__ import annotations

import hashlib
import json
import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quaternion_yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Heading of a rotation [FN-01]."""
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def rotation_matrix(w: float, x: float, y: float, z: float) -> list[list[float]]:
    """The rotation of a unit quaternion [FN-16]."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def speed(vx: Column, vy: Column) -> Column:
    return F.hypot(vx, vy)


def millionths(x: Column) -> Column:
    """F.round(x, 6), which goes by decimals only for large values and near ties: they cost more than measuring a distance."""
    scaled = x * 1e6
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.rint(scaled) / 1e6 + 0.0).otherwise(F.round(x, 6))


def alias_letters(k: Column) -> Column:
    """A to Z, then AA, BB and so on: the letter repeated [FN-08]."""
    return F.repeat(F.char(65 + k % 26), (F.floor(k / 26) + 1).cast("int"))


def alias_base26(k: Column) -> Column:
    """A to Z, then AA, AB and so on: numbers without a zero in base 26 [FN-09]."""
    digits = F.sequence(F.lit(1), F.lit(14))
    begin = F.struct(k.cast("long").alias("left"), F.lit("").alias("text"))

    def step(s, _):
        rest = F.floor(s["left"] / 26).cast("long") - 1
        return F.when(s["left"] < 0, s).otherwise(F.struct(rest.alias("left"), F.concat(F.char(65 + s["left"] % 26), s["text"]).alias("text")))

    return F.aggregate(digits, begin, step)["text"]


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent within 0 and 100; null for an unknown or empty whole [FN-13]."""
    return F.when(whole > 0, F.least(F.greatest(100.0 * part / whole, F.lit(0.0)), F.lit(100.0)))


def rounded(x: Column, digits: int) -> Column:
    """Half to even, and 0 instead of -0 [FN-07]."""
    r = F.bround(x, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def rotation_columns(w: Column, x: Column, y: Column, z: Column) -> Column:
    """The rotation of a unit quaternion, its nine numbers by rows [FN-16]."""
    return F.array(*[c for row in rotation_matrix(w, x, y, z) for c in row])


def fixed_text(value: Column, digits: int) -> Column:
    """A number of 0 or more with a fixed count of digits, rounded by its exact binary value, as C's printf does.

    Spark's own rounding and formats start from the shortest decimal that names a number, which may be a tie where the
    number itself is none. Products of the two halves of the fraction are exact, so their sum has the right sign.
    """
    scale = 10**digits
    whole = F.floor(value)
    part = value - whole
    upper = F.floor(part * 2.0**26) / 2.0**26
    lower = part - upper
    down = F.floor(upper * scale + lower * scale)
    above = (upper * scale - down - 0.5) + lower * scale
    units = whole * scale + down
    units = units + F.when((above > 0) | ((above == 0) & (units % 2 != 0)), 1).otherwise(0)
    if digits == 0:
        return units.cast("string")
    return F.concat(F.floor(units / scale).cast("string"), F.lit("."), F.lpad((units % scale).cast("string"), digits, "0"))


def signed_text(value: Column, digits: int = 1, unit: str = "") -> Column:
    """A fixed-point number with its sign, never -0, or unknown [FN-15]."""
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    size = fixed_text(F.abs(value), digits)
    sign = F.when((value < 0) & F.rlike(size, F.lit("[1-9]")), "-").otherwise("+")
    return F.when(known, F.concat(sign, size, F.lit(unit))).otherwise("unknown")


def signed(value: float | None, digits: int = 1, unit: str = "") -> str:
    """A fixed-point number with its sign, never -0, or unknown [FN-07, FN-15]."""
    if value is None or not math.isfinite(value):
        return "unknown"
    value = round(value, digits) + 0.0
    return f"{value:+.{digits}f}{unit}"


def shortest(value: float) -> str:
    """The number with its sign and no needless digits, as %+g writes it [FN-07]."""
    return f"{value + 0.0:+g}"


@F.arrow_udf(T.StringType())
def _keys(questions: pa.Array, states: pa.Array, models: pa.Array, providers: pa.Array, endpoints: pa.Array, versions: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (questions, states, models, providers, endpoints, versions)), strict=True)
    return pa.array([cache_key(*r) for r in rows], pa.string())


def cache_key(questions: str, state: str, model: str | None = None, provider: str | None = None, endpoint: str | None = None, version: str | None = None) -> str:
    """Digest of what an answer depends on: sorted JSON of model, questions and state, with the provider's fields unless it is the default one [FN-10]."""
    key = {"model": model or "default", "questions": json.loads(questions), "state": state}
    if provider is not None:
        key |= {"provider": provider, "endpoint": endpoint, "adapter": version}
    return hashlib.sha256(json.dumps(key, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def cache_key_column(questions: Column, state: Column, model: Column, provider: Column, endpoint: Column, version: Column) -> Column:
    """cache_key of columns. JSON as Python writes it has no equal among Spark's functions."""
    return _keys(questions, state, model, provider, endpoint, version)


def turn_direction(line: Column, straight: float = 30.0, u_turn: float = 135.0) -> Column:
    """left, right, u-turn or straight, by the change of heading between the first and last four points of a line [FN-05]."""
    n = F.size(line)
    k = F.least(F.lit(4), n)
    at = lambda i: F.try_element_at(line, F.greatest(i, F.lit(1)).cast("int"))
    heading = lambda a, b: F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    turn = F.degrees(F.pmod(heading(at(n - k + 1), at(n)) - heading(at(F.lit(1)), at(k)) + math.pi, F.lit(2 * math.pi)) - math.pi)
    return F.when(n < 2, F.lit(None).cast("string")).when(F.abs(turn) > u_turn, "u-turn").when(F.abs(turn) < straight, "straight").when(turn > 0, "left").otherwise("right")


def crossable(kind: Column, subtype: Column) -> Column:
    """Whether a lane's border may be crossed: virtual, or dashed [OR-09]."""
    return F.coalesce((kind == "virtual") | F.contains(subtype, F.lit("dashed")), F.lit(False))


def light_text(circles: Column, arrows: Column) -> Column:
    """Distinct sorted circles, then arrows, joined; no elements give none, none usable unknown [SRC-06]."""
    clean = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull())))
    empty = F.size(circles) + F.size(arrows) == 0
    text = F.array_join(F.concat(clean(circles), clean(arrows)), " + ")
    return F.when(empty, "none").when(text == "", "unknown").otherwise(text)


def hex_id(raw: Column) -> Column:
    """An id's bytes in lower-case hex; null if all are 0 [SRC-05]."""
    text = F.lower(F.hex(raw))
    return F.when(F.length(F.replace(text, F.lit("0"), F.lit(""))) > 0, text)
