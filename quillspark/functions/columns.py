"""Small column helpers: one evaluation of a shared value, Python's rounding and trimming."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

#: White space as Python's str methods see it, for Java patterns.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same one by one, to trim by.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, wherever the planner moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def squeeze(c: Column | str) -> Column:
    """White space runs as single spaces, ends trimmed."""
    return F.btrim(F.regexp_replace(col(c), f"{WS}+", " "))


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def any_of(values: Iterable[str], test: Callable[[Column], Column]) -> Column:
    return F.exists(strings(*values), test)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def py_round(x: Column, digits: int) -> Column:
    """Round the exact binary value half to even, as Python does, for |x| * 10**digits below 2**52.

    The product's rounding error is recovered by splitting x, so that ties are seen exactly. That names x some twenty
    times, so it is bound first.
    """
    return let(x.cast("double"), lambda v: _rounded(v, digits))


def _rounded(x: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    product = x * scale
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    error = (high * scale - product) + (x - high) * scale
    down = F.floor(product).cast("double")
    beyond = (product - down - 0.5) + error
    odd = F.pmod(down, F.lit(2.0)) == 1.0
    up = (beyond > 0) | ((beyond == 0) & odd)
    # an error just below a whole product belongs to the step under it, where it is far above the half
    return F.when(x.isNull() | F.isnan(x), x).otherwise((down + F.when(up, 1.0).otherwise(0.0)) / scale)
