"""Scalar functions over columns, all native."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digitize(value: Column | str, thresholds: Sequence[float]) -> Column:
    """How many thresholds are at or below the value (bins open to the right; NaN is in the last)."""
    if any(b <= a for a, b in zip(thresholds, thresholds[1:], strict=False)):
        raise ValueError("thresholds must strictly increase")
    v, total = col(value), F.lit(0)
    for t in thresholds:
        total = total + F.when(v >= F.lit(float(t)), 1).otherwise(0)
    return F.when(v.isNull(), F.lit(None).cast("int")).otherwise(total).cast("int")


def is_finite(value: Column | str) -> Column:
    """Names the value once, as a filter on a parsed value parses it each time that it is named; NaN is above infinity."""
    return F.coalesce(F.abs(col(value).cast("double")) < float("inf"), F.lit(False))


def draw(*parts: Column | str | int) -> Column:
    """A portable pseudo-random 32-bit number from the parts' text: the same in any engine with MD5."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substr(F.md5(key.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def label_text(value: Column | str) -> Column:
    return F.lower(F.trim(col(value)))


def map_label(value: Column | str, mapping: dict[str, int]) -> Column:
    """The class of a label's text; an unmapped label is an error."""
    out, key = None, label_text(value)
    for k, v in mapping.items():
        out = F.when(key == k.strip().lower(), v) if out is None else out.when(key == k.strip().lower(), v)
    return out.when(col(value).isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("unmapped label: "), key))).cast("int")


def block_name(rank: Column, size: int) -> Column:
    return F.format_string("block_%04d", F.floor(rank / size).cast("bigint"))


def layer_class(layer: Column | str, tiers: Sequence[tuple[float, float, str]]) -> Column:
    """The first tier (low, high, name) with low < layer <= high, else `other`."""
    x, out = col(layer), None
    for low, high, name in tiers:
        hit = (x > float(low)) & (x <= float(high))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def root_id(text: Column | str) -> Column:
    """Canonical integer text of an id that may carry blanks or a fraction."""
    return F.substring_index(F.trim(col(text)), ".", 1).cast("bigint").cast("string")


def metric_value(text: Column | str) -> Column:
    """A number, or null if it is missing, can't be read or isn't finite."""
    v = col(text).cast("string").try_cast("double")
    return F.when(is_finite(v), v)


def significant(value: Column | str, digits: int) -> Column:
    """A number between 0 and 1 as text with so many significant digits, without zeros at its end; below 1e-4 with an
    exponent of two digits."""
    v = col(value)
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = strip(F.format_string(f"%.{digits - 1}f", v))
    for e in range(-1, -5, -1):
        plain = F.when(v < 10.0 ** (e + 1), strip(F.format_string(f"%.{digits - 1 - e}f", v))).otherwise(plain)
    power = F.floor(F.log10(v)).cast("int")
    small = F.concat(strip(F.format_string(f"%.{digits - 1}f", v / F.pow(F.lit(10.0), power))), F.format_string("e-%02d", -power))
    return F.when(v == 0, "0").when(v < 1e-4, small).otherwise(plain)


def p_text(p: Column | str, digits: int = 6, floor: float = 1e-12) -> Column:
    """A p-value for a report: `n/a` if not finite, `<1e-12` below the floor, else significant digits."""
    v = col(p)
    return F.when(~is_finite(v), "n/a").when(v < floor, "<1e-12").otherwise(significant(v, digits))


def condition_label(fraction: Column | str) -> Column:
    """`full`, `train25pct` or `train0p125` for a training fraction; one outside (0, 1] is an error."""
    f = col(fraction)
    percent = f * 100
    whole = F.abs(percent - F.round(percent)) < 1e-9
    other = F.concat(F.lit("train"), F.replace(significant(f, 4), F.lit("."), F.lit("p")))
    label = F.when(f.isNull() | (f == 1), "full").when(whole, F.format_string("train%dpct", F.round(percent).cast("int"))).otherwise(other)
    return F.when(f.isNull() | ((f > 0) & (f <= 1)), label).otherwise(F.raise_error(F.lit("a training fraction lies in (0, 1]")))


def component(value: Column | str) -> Column:
    return F.coalesce(col(value).cast("string"), F.lit("n/a"))


def short_hash(*parts: Column, length: int = 16) -> Column:
    """Leading hexadecimal digits of SHA-256 over the parts, parted by a bar, missing ones as n/a."""
    return F.substr(F.sha2(F.concat_ws("|", *[component(p) for p in parts]).cast("binary"), 256), F.lit(1), F.lit(length))


def run_id(dataset: Column, model: Column, task: Column, seed: Column, fold: Column) -> Column:
    return F.format_string("%s|%s|%s|seed%02d|fold%02d", dataset, model, task, seed, fold)


def unit_id(text: Column | str, pattern: str) -> Column:
    """First group of a pattern, or the text itself where it doesn't match."""
    found = F.regexp_extract(col(text), pattern, 1)
    return F.when(found == "", col(text)).otherwise(found)


def softmax(scores: Column | str) -> Column:
    s = col(scores)
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def pick_evenly(values: Column | str, n: Column | str, m: int) -> Column:
    """m elements at evenly spaced places, from the first to the last; places are cut to integers."""
    v, size = col(values), col(n)
    at = [F.floor(F.lit(i) * (size - 1) / max(1, m - 1)).cast("int") + 1 for i in range(m)]
    return F.array(*[F.element_at(v, a) for a in at])
