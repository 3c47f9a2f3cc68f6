"""Results kept as factors, whose product is expanded only where a later label needs it.

A contraction whose operands hang together by output labels alone, or not at all, has a result that is
larger than all that is in it: an outer product has the product of its operands' rows. Such a result is kept as a
list of factors, one for each group of operands that summed labels hold together. A contraction with it puts the factors in its place,
so that the order of contraction is chosen over all of them and sums go below products.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.algebra import STANDARD, Algebra
from ..functions.algebra import algebra as named
from ..plans.spec import EinsumSpec
from ..sources.tensor import TensorRel
from .contract import einsum as whole
from .contract import prepared


class Factored:
    """A tensor with axes iy that is the product of factors with axes ixs; labels are numbers of its own."""

    def __init__(self, factors: Sequence[TensorRel], ixs: Sequence[Sequence[int]], iy: Sequence[int], algebra_: Algebra):
        self.factors, self.ixs, self.iy, self.algebra = list(factors), [tuple(x) for x in ixs], tuple(iy), algebra_
        self.sizes = {c: n for t, x in zip(self.factors, self.ixs, strict=True) for c, n in zip(x, t.shape, strict=True)}
        self.dtype = self.factors[0].dtype

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.sizes[c] for c in self.iy)

    @property
    def ndim(self) -> int:
        return len(self.iy)

    def __repr__(self) -> str:
        return f"Factored(shape={list(self.shape)}, factors={[list(t.shape) for t in self.factors]})"

    def expand(self) -> TensorRel:
        """The product as one relation."""
        return whole(EinsumSpec(self.ixs, self.iy), *self.factors, algebra=self.algebra)


def groups(spec: EinsumSpec) -> list[list[int]]:
    """Operands held together by summed labels, in order."""
    of = list(range(len(spec.ixs)))
    first: dict = {}
    for i, ix in enumerate(spec.ixs):
        for c in ix:
            if c not in spec.iy:
                a, b = of[first.setdefault(c, i)], of[i]
                of = [min(a, b) if x in (a, b) else x for x in of]
    return [[i for i, x in enumerate(of) if x == k] for k in sorted(set(of))]


def substituted(spec: EinsumSpec, tensors: Sequence[TensorRel | Factored]) -> tuple[EinsumSpec, list[TensorRel]]:
    """The contraction over the factors of its factored operands; a label that stands at two axes of one is one label."""
    ixs, flat, joined, number = [], [], {}, 0

    def root(c):
        while c in joined:
            c = joined[c]
        return c

    for ix, t in zip(spec.ixs, tensors, strict=True):
        if not isinstance(t, Factored):
            ixs.append([("outer", c) for c in ix])
            flat.append(t)
            continue
        for c, own in zip(ix, t.iy, strict=True):
            a, b = root((number, own)), root(("outer", c))
            if a != b:
                joined[a] = b
        ixs += [[(number, c) for c in x] for x in t.ixs]
        flat += t.factors
        number += 1
    out = EinsumSpec([[root(c) for c in x] for x in ixs], [root(("outer", c)) for c in spec.iy])
    return out.bind([t.shape for t in flat]), flat


def flattened(spec, tensors, algebra, sizes) -> tuple[EinsumSpec, list[TensorRel], Algebra]:
    a = named(algebra)
    spec, _ = prepared(spec, tensors, a, sizes)
    for t in tensors:
        if isinstance(t, Factored) and t.algebra is not a:
            raise ValueError(f"a product under {t.algebra.name} in a contraction under {a.name}")
    plain, flat = substituted(spec, tensors)
    return plain, flat, a


def einsum(spec: EinsumSpec | str, *tensors: TensorRel | Factored, algebra: str | Algebra = STANDARD, sizes=None, method: str = "greedy") -> TensorRel:
    """As contract.einsum; operands may be factored. The order is chosen anew, over all factors."""
    plain, flat, a = flattened(spec, tensors, algebra, sizes)
    return whole(plain, *flat, algebra=a, method=method)


def factored(spec: EinsumSpec | str, *tensors: TensorRel | Factored, algebra: str | Algebra = STANDARD) -> Factored:
    """The result as factors: each group of operands that summed labels hold together is contracted, the groups aren't multiplied.

    Output labels must stand in an operand.
    """
    plain, flat, a = flattened(spec, tensors, algebra, None)
    factors, ixs = [], []
    for group in groups(plain):
        some = [plain.ixs[i] for i in group]
        labels = [c for c in dict.fromkeys(c for x in some for c in x) if c in set(plain.iy)]
        one = len(group) == 1 and list(some[0]) == labels
        factors.append(flat[group[0]] if one else whole(EinsumSpec(some, labels), *[flat[i] for i in group], algebra=a))
        ixs.append(labels)
    ids = {c: i for i, c in enumerate(dict.fromkeys(c for x in ixs for c in x))}
    return Factored(factors, [[ids[c] for c in x] for x in ixs], [ids[c] for c in plain.iy], a)
