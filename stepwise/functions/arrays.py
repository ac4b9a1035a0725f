"""Vector functions on array columns (F5, F7-F11, P10), all JVM-side
higher-order expressions (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Without this, a per-row statistic used inside ``transform``/``aggregate``
    would be recomputed for every array element (quadratic work per row).
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, body)


def pad_array(c, n, pad=0) -> Column:
    """right-pad an array to length ``n`` (longer arrays are left unchanged)."""
    c = _c(c)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.concat(c, F.array_repeat(F.lit(pad), F.greatest(n - F.size(c), F.lit(0))))


def argmax(c) -> Column:
    """0-based index of the first maximum; NULL for an empty array."""
    c = _c(c)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def array_sum(c) -> Column:
    return F.aggregate(_c(c), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def logsumexp(c) -> Column:
    c = _c(c)
    return let(F.array_max(c).cast("double"),
               lambda m: m + F.log(F.aggregate(c, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))))


def softmax(c) -> Column:
    """F8: softmax over the array (max-shifted for stability)."""
    c = _c(c)
    return let(logsumexp(c), lambda lse: F.transform(c, lambda x: F.exp(x.cast("double") - lse)))


def cross_entropy(logits, label) -> Column:
    """F9 per row: -log softmax(logits)[label] (label is 0-based)."""
    logits = _c(logits)
    return logsumexp(logits) - F.element_at(logits, _c(label) + 1).cast("double")


def mean_cross_entropy(logits, label, ignore_index=None) -> Column:
    """F9 aggregate: mean over rows whose label differs from ``ignore_index``."""
    ce = cross_entropy(logits, label)
    if ignore_index is not None:
        ce = F.when(_c(label) != F.lit(ignore_index), ce)
    return F.avg(ce)


def layer_norm(c, weight=None, bias=None) -> Column:
    """(x - mean) / sample_std * w + b, no epsilon; NULL when std is 0 or n < 2."""
    c = _c(c)
    n = F.size(c).cast("double")
    w = _c(weight) if weight is not None else None
    b = _c(bias) if bias is not None else None

    def with_mean(mean):
        ss = F.aggregate(c, F.lit(0.0).cast("double"), lambda acc, x: acc + (x - mean) * (x - mean))

        def with_std(std):
            if w is None and b is None:
                out = F.transform(c, lambda x: (x - mean) / std)
            else:
                ww = w if w is not None else F.array_repeat(F.lit(1.0), F.size(c))
                bb = b if b is not None else F.array_repeat(F.lit(0.0), F.size(c))
                out = F.transform(c, lambda x, i: (x - mean) / std * F.element_at(ww, i + 1)
                                  + F.element_at(bb, i + 1))
            return F.when((n > 1) & (std > 0), out)

        return let(F.sqrt(F.try_divide(ss, n - 1)), with_std)

    return let(F.try_divide(array_sum(c), n), with_mean)


def relu(c) -> Column:
    """F11."""
    return F.transform(_c(c), lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def rescale(c, scale: float = 255.0) -> Column:
    """P10 final step: bytes -> [0, 1]."""
    return F.transform(_c(c), lambda x: x.cast("double") / F.lit(float(scale)))


def channels_first(c, height: int, width: int, channels: int) -> Column:
    """P10 layout move: (h, w, c) row-major -> (c, h, w) row-major, by index arithmetic."""
    c = _c(c)
    hw = height * width
    idx = F.sequence(F.lit(0), F.lit(hw * channels - 1))
    return F.transform(idx, lambda j: F.element_at(c, (j % hw) * channels + F.floor(j / hw).cast("int") + 1))


def round_array(c, places: int = 6) -> Column:
    return F.transform(_c(c), lambda x: F.round(x.cast("double"), places))
