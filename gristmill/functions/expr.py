"""Column expressions that the operators share. All are built-in functions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null (ANSI division would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x between bounds; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded for results, so that the last bits of sums in another order don't show."""
    return F.round(x.cast("double"), digits)


def by(*keys: str, order: str | list[str] = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def rolling(fn, c: str | Column, n: int, w: WindowSpec, partial: bool = False) -> Column:
    """fn over the last n rows; null until n values are there, unless ``partial``."""
    frame = w.rowsBetween(1 - n, 0)
    c = F.col(c) if isinstance(c, str) else c
    value = fn(c).over(frame)
    return value if partial else F.when(F.count(c).over(frame) == n, value)


def log_loss_term(p: Column, y: Column, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return -F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p))


def lowest_bit(h: Column) -> Column:
    """Place of the lowest set bit of a long."""
    return F.bit_count(h.bitwiseAND(-h) - 1)


def tag(condition: Column, name: str) -> Column:
    """``name`` where the condition holds, null where not or unknown."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(name))


def tags(*pairs: tuple[Column, str]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*(tag(c, n) for c, n in pairs)))
