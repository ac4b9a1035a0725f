"""Scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the summary timestamp format (microseconds, local wall clock).
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def string_suffix(c, n: int = 4) -> Column:
    """Last ``n`` characters (the whole string when shorter)."""
    return F.substring(_c(c), -n, n)


def param_count(width, depth, input_dim, output_dim) -> Column:
    """Parameters of an MLP with ``depth`` hidden width x width layers, biases included."""
    w, d = _c(width).cast("bigint"), _c(depth).cast("bigint")
    i = input_dim if isinstance(input_dim, Column) else F.lit(input_dim).cast("bigint")
    o = output_dim if isinstance(output_dim, Column) else F.lit(output_dim).cast("bigint")
    return (i * w + w + d * (w * w + w) + w * o + o).cast("bigint")


def timestamp_str(c) -> Column:
    """F12."""
    return F.date_format(_c(c), TIMESTAMP_FORMAT)


def run_dir(run_id) -> Column:
    """1-based run number zero-padded to 4 digits (wider numbers are not truncated)."""
    return F.format_string("%04d", _c(run_id).cast("bigint"))


def json_dump(*cols) -> Column:
    """one JSON object per row."""
    return F.to_json(F.struct(*cols))


def json_load(c, schema) -> Column:
    """F14."""
    return F.from_json(_c(c), schema)


def series_label(*parts, sep: str = "_") -> Column:
    """``concat_ws`` that keeps NULL parts visible as 'None' (like an f-string)."""
    return F.concat_ws(sep, *[F.coalesce(_c(p).cast("string"), F.lit("None")) for p in parts])
