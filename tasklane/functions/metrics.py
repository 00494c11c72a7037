"""Per-row scoring expressions over a ``logits array<double>`` column (M1-M4).

All are higher-order array expressions: no Python, no explode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-7


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def log_sum_exp(logits) -> Column:
    """``max + ln(sum(exp(x - max)))`` (numerically shifted)."""
    x = _c(logits)
    mx = F.array_max(x)
    s = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - mx))
    return mx + F.log(s)


def softmax(logits) -> Column:
    """M1: probabilities."""
    x = _c(logits)
    lse = log_sum_exp(x)
    return F.transform(x, lambda v: F.exp(v - lse))


def log_softmax(logits) -> Column:
    x = _c(logits)
    lse = log_sum_exp(x)
    return F.transform(x, lambda v: v - lse)


def argmax(logits) -> Column:
    """M2: index of the first maximum (0-based int)."""
    x = _c(logits)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def target_logit(logits, target) -> Column:
    return F.element_at(_c(logits), _c(target) + 1)


def cross_entropy(logits, target) -> Column:
    """M3 per row: ``lse - logit[target]``."""
    return log_sum_exp(logits) - target_logit(logits, target)


def focal(logits, target, alpha: float = 1.0, gamma: float = 1.0,
          is_prob: bool = False, eps: float = EPS) -> Column:
    """M4 per row: ``-alpha (1-p)^gamma ln p`` at the target class.

    p = softmax + eps unless ``is_prob``; ``1-p`` is floored at 0 so a
    fractional gamma never yields NaN.
    """
    if is_prob:
        p = target_logit(logits, target)
    else:
        p = F.exp(target_logit(logits, target) - log_sum_exp(logits)) + eps
    w = F.lit(alpha) * F.pow(F.greatest(F.lit(1.0) - p, F.lit(0.0)),
                             F.lit(gamma))
    return -w * F.log(p)
