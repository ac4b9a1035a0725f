"""Nested config <-> dotted columns.

Both directions are pure projections computed from the schema on the
driver; no job runs and Catalyst prunes unused leaves from the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs become columns named ``a<sep>b``; arrays stay leaves,
    empty structs vanish."""
    cols: list[Column] = []

    def walk(dtype, path: list[str], expr: Column):
        if isinstance(dtype, StructType):
            for f in dtype.fields:
                walk(f.dataType, path + [f.name], expr.getField(f.name))
        else:
            cols.append(expr.alias(sep.join(path)))

    for f in df.schema.fields:
        walk(f.dataType, [f.name], F.col(_q(f.name)))
    return df.select(*cols)


def unflatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Columns named ``a<sep>b`` become nested structs (inverse of N1).

    A name that is both a leaf and a prefix of another (``a`` and ``a.b``)
    raises, in either order.
    """
    def level(columns: list[tuple[list[str], str]]) -> list[Column]:
        """One expression per distinct first component, in order of first appearance."""
        groups: dict[str, list[tuple[list[str], str]]] = {}
        for parts, name in columns:
            groups.setdefault(parts[0], []).append((parts[1:], name))
        out = []
        for head, members in groups.items():
            leaves = [name for rest, name in members if not rest]
            if leaves and len(members) > 1:
                raise ValueError(f"column {leaves[0]!r} clashes with a nested group of the same name")
            out.append((F.col(_q(leaves[0])) if leaves else F.struct(*level(members))).alias(head))
        return out

    return df.select(*level([(name.split(sep), name) for name in df.columns]))
