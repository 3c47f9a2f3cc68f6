"""Slices: labels that are fixed, so that every operand and intermediate result of a tree has few cells.

A contraction with a label fixed to each of its values in turn gives parts whose sum is the result (or,
where the output has the label, parts that stand side by side). Fixing makes results smaller by the label's
size and work larger by at most as much.
"""

from __future__ import annotations

import math
from collections.abc import Hashable

from .order import complexity
from .spec import EinsumSpec
from .tree import steps


def fixed(spec: EinsumSpec, labels) -> EinsumSpec:
    """The contraction of one slice, with labels of size one."""
    return spec.with_sizes({c: 1 for c in labels})


def largest(spec: EinsumSpec) -> tuple[float, set[Hashable]]:
    """Size of the largest operand or result as log2, and the labels of all of that size."""
    log = {c: math.log2(max(1, n)) for c, n in spec.sizes.items()}
    every = [set(x) for x in spec.ixs] + [set(spec.iy)] + [set(s.labels) for s in (steps(spec.tree, spec.ixs, spec.iy) if len(spec.ixs) > 1 else [])]
    sizes = [sum(log[c] for c in x) for x in every]
    top = max(sizes)
    return top, set().union(*(x for x, n in zip(every, sizes, strict=True) if n > top - 1e-9))


def slice_labels(spec: EinsumSpec, cells: int) -> tuple[Hashable, ...]:
    """Labels to fix until nothing has more than `cells` cells, one after the other.

    Of the labels of the largest results that one is taken that leaves the least work in all
    slices together among those that leave the smallest results.
    """
    if spec.tree is None and len(spec.ixs) > 1:
        raise ValueError("slices are chosen for a tree")
    chosen: list[Hashable] = []
    place = {c: i for i, c in enumerate(spec.sizes)}
    while True:
        now = fixed(spec, chosen)
        top, labels = largest(now)
        if top <= math.log2(max(1, cells)) + 1e-9:
            return tuple(chosen)

        def cost(c, now=now):
            after = complexity(fixed(now, [c]))
            return after.sc, after.tc + math.log2(now.sizes[c]), place[c]

        chosen.append(min((c for c in labels if now.sizes[c] > 1), key=cost))


def slices(spec: EinsumSpec, labels) -> int:
    return math.prod(spec.sizes[c] for c in labels)
