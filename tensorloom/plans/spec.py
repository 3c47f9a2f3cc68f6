"""What to contract: labels of each operand and of the output, and their sizes."""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence
from dataclasses import dataclass, field

from .tree import Tree, parse_groups


@dataclass(frozen=True)
class EinsumSpec:
    """ixs: labels of each operand's axes; iy: labels of the output; sizes by label."""

    ixs: tuple[tuple[Hashable, ...], ...]
    iy: tuple[Hashable, ...]
    sizes: Mapping[Hashable, int] = field(default_factory=dict)
    tree: Tree | None = None

    def __post_init__(self):
        object.__setattr__(self, "ixs", tuple(tuple(x) for x in self.ixs))
        object.__setattr__(self, "iy", tuple(self.iy))
        object.__setattr__(self, "sizes", dict(self.sizes))
        if not self.ixs:
            raise ValueError("an einsum needs at least one operand")

    @property
    def is_optimized(self) -> bool:
        return self.tree is not None

    @property
    def contraction_tree(self) -> Tree | None:
        return self.tree

    def with_tree(self, tree: Tree) -> EinsumSpec:
        tree.check(len(self.ixs))
        return EinsumSpec(self.ixs, self.iy, self.sizes, tree)

    def with_sizes(self, sizes: Mapping[Hashable, int]) -> EinsumSpec:
        return EinsumSpec(self.ixs, self.iy, {**self.sizes, **sizes}, self.tree)

    def bind(self, shapes: Sequence[Sequence[int]]) -> EinsumSpec:
        """Sizes from the operands' shapes, checked against those given."""
        return self.with_sizes(infer_sizes(self.ixs, shapes, self.sizes, self.iy))

    def __str__(self) -> str:
        text = lambda x: "".join(map(str, x)) if all(len(str(c)) == 1 for c in x) else " ".join(map(str, x))
        return ",".join(map(text, self.ixs)) + "->" + text(self.iy)


def infer_sizes(ixs, shapes, given: Mapping[Hashable, int] | None = None, iy=()) -> dict[Hashable, int]:
    """One size for each label; given sizes are needed for output labels that no operand has."""
    if len(ixs) != len(shapes):
        raise ValueError(f"{len(ixs)} operands in the expression, {len(shapes)} tensors")
    sizes = dict(given or {})
    for i, (ix, shape) in enumerate(zip(ixs, shapes, strict=True)):
        if len(ix) != len(shape):
            raise ValueError(f"operand {i} has rank {len(shape)}, the expression names {len(ix)} labels")
        for label, n in zip(ix, shape, strict=True):
            if sizes.setdefault(label, n) != n:
                raise ValueError(f"label {label!r} has sizes {sizes[label]} and {n}")
    for label in iy:
        if label not in sizes:
            raise ValueError(f"no size for output label {label!r}")
    return sizes


class EinBuilder:
    """EinBuilder().input("ij").input("jk").output("ik").size("i", 2) ... .build()"""

    def __init__(self):
        self._ixs: list[tuple] = []
        self._iy: tuple | None = None
        self._sizes: dict = {}

    def input(self, labels) -> EinBuilder:
        self._ixs.append(tuple(labels))
        return self

    def output(self, labels) -> EinBuilder:
        self._iy = tuple(labels)
        return self

    def size(self, label, n: int) -> EinBuilder:
        self._sizes[label] = n
        return self

    def sizes(self, pairs) -> EinBuilder:
        self._sizes.update(dict(pairs))
        return self

    def build(self) -> EinsumSpec:
        if self._iy is None:
            raise ValueError("no output labels were given")
        for label in [*(c for x in self._ixs for c in x), *self._iy]:
            if label not in self._sizes:
                raise ValueError(f"no size for label {label!r}")
        return EinsumSpec(tuple(self._ixs), self._iy, self._sizes)


def labels_of(text: str, what: str) -> tuple[str, ...]:
    for c in text:
        if not ("a" <= c <= "z"):
            raise ValueError(f"Invalid character {c!r} in {what}: labels are a to z")
    return tuple(text)


def parse(expression: str, sizes: Mapping[str, int] | None = None) -> EinsumSpec:
    """ "ij,jk->ik", or "(ij,jk),kl->il" whose parentheses give the order. White space is ignored.

    Output labels must occur in an input or have a size. With parentheses every group has two members.
    """
    text = "".join(expression.split())
    left, arrow, right = text.partition("->")
    if not arrow:
        raise ValueError(f"Expression {expression!r} must contain '->'")
    if "->" in right:
        raise ValueError(f"Expression {expression!r} has more than one '->'")
    iy = labels_of(right, "the output")
    if "(" in left or ")" in left:
        groups, ixs = parse_groups(left, lambda x: labels_of(x, "an input"))
    else:
        groups, ixs = None, [labels_of(x, "an input") for x in left.split(",")]
        if any(not x for x in ixs):
            raise ValueError(f"Empty input group in {expression!r}")
    known = {c for x in ixs for c in x} | set(sizes or ())
    for c in iy:
        if c not in known:
            raise ValueError(f"Output label {c!r} doesn't occur in any input")
    spec = EinsumSpec(tuple(ixs), iy)
    if groups is None:
        return spec
    return spec.with_tree(groups)


def label_ids(spec: EinsumSpec) -> dict[str, int]:
    """Numbers for labels in order of first appearance."""
    ids: dict[str, int] = {}
    for c in [*(c for x in spec.ixs for c in x), *spec.iy]:
        ids.setdefault(c, len(ids))
    return ids
