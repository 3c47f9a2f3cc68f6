"""A contraction as SQL: flat (join everything, then group), which states the result, or along a tree, for networks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from .spec import EinsumSpec
from .tree import steps

#: Product and aggregate by algebra.
FORMS = {"standard": (" * ", "SUM"), "maxplus": (" + ", "MAX"), "minplus": (" + ", "MIN"), "maxmul": (" * ", "MAX")}


def flat_sql(spec: EinsumSpec, tables: Sequence[str], algebra: str = "standard", kind: str = "BIGINT", new: Mapping | None = None) -> str:
    """SELECT d0, ..., v for tables with such columns; new gives sizes of labels that no operand has.

    A sum over nothing gives 0 where the result is a scalar.
    """
    times, plus = FORMS[algebra]
    where: dict = {}
    conditions, sources = [], []
    for i, (ix, table) in enumerate(zip(spec.ixs, tables, strict=True)):
        sources.append(f"{table} t{i}")
        for j, c in enumerate(ix):
            here = f"t{i}.d{j}"
            if c in where:
                conditions.append(f"{where[c]} = {here}")
            else:
                where[c] = here
    for c in dict.fromkeys(spec.iy):
        if c not in where:
            sources.append(f"range({new[c]}) r_{c}(x)")
            where[c] = f"r_{c}.x"
    value = times.join(f"t{i}.v" for i in range(len(tables)))
    dropped = any(c not in spec.iy for x in spec.ixs for c in x)
    if dropped:
        value = f"{plus}({value})"
        if not spec.iy:
            value = f"COALESCE({value}, 0)"
    out = [f"CAST({where[c]} AS BIGINT) AS d{i}" for i, c in enumerate(spec.iy)] + [f"CAST({value} AS {kind}) AS v"]
    sql = f"SELECT {', '.join(out)} FROM {', '.join(sources)}"
    if conditions:
        sql += " WHERE " + " AND ".join(conditions)
    if dropped and spec.iy:
        sql += " GROUP BY " + ", ".join(dict.fromkeys(where[c] for c in spec.iy))
    return sql


def tree_sql(spec: EinsumSpec, tables: Sequence[str], algebra: str = "standard", kind: str = "BIGINT") -> str:
    """One table expression for each contraction of the spec's tree; the last one is the result."""
    name = lambda i: tables[i] if i < len(tables) else f"s{i}"
    todo = steps(spec.tree, spec.ixs, spec.iy)
    parts = [f"{name(s.out)} AS MATERIALIZED ({flat_sql(EinsumSpec((s.left_labels, s.right_labels), s.labels), [name(s.left), name(s.right)], algebra, kind)})" for s in todo]
    last = todo[-1]
    return ", ".join(parts) + " " + flat_sql(EinsumSpec((tuple(last.labels),), spec.iy), [name(last.out)], algebra, kind)
