"""Contraction trees: which two intermediate results are contracted when."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Leaf:
    index: int

    def leaves(self) -> Iterator[int]:
        yield self.index

    def check(self, n: int) -> None:
        check_leaves(self, n)


@dataclass(frozen=True)
class Node:
    left: Tree
    right: Tree

    def leaves(self) -> Iterator[int]:
        todo: list[Tree] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, Leaf):
                yield x.index
            else:
                todo += [x.right, x.left]

    def check(self, n: int) -> None:
        check_leaves(self, n)


Tree = Leaf | Node


def check_leaves(tree: Tree, n: int) -> None:
    """Every operand must be used exactly once."""
    found = Counter(tree.leaves())
    for i in found:
        if not 0 <= i < n:
            raise ValueError(f"tensor index {i} out of range for {n} tensors")
    if any(k > 1 for k in found.values()):
        raise ValueError("a tensor is used more than once in the tree")
    if len(found) < n:
        raise ValueError(f"tensors {sorted(set(range(n)) - found.keys())} aren't used in the tree")


def left_deep(n: int) -> Tree:
    tree: Tree = Leaf(0)
    for i in range(1, n):
        tree = Node(tree, Leaf(i))
    return tree


@dataclass
class Step:
    """One contraction: operands and result by number (inputs first), with their labels."""

    left: int
    right: int
    out: int
    left_labels: tuple[Hashable, ...]
    right_labels: tuple[Hashable, ...]
    labels: tuple[Hashable, ...]


def steps(tree: Tree, ixs: Sequence[Sequence[Hashable]], iy: Sequence[Hashable]) -> list[Step]:
    """Contractions in post-order. A result keeps a label if the output or an operand outside its subtree has it."""
    uses = Counter(c for x in ixs for c in set(x))
    out: list[Step] = []
    keep = set(iy)

    def merge(a, b):
        """(number, labels, uses of labels inside) of the contraction of two results."""
        inside = a[2] + b[2]
        labels = tuple(c for c in dict.fromkeys([*a[1], *b[1]]) if c in keep or inside[c] < uses[c])
        out.append(Step(a[0], b[0], len(ixs) + len(out), a[1], b[1], labels))
        return out[-1].out, labels, Counter({c: inside[c] for c in labels})

    done: list = []
    todo: list = [(tree, False)]
    while todo:
        x, ready = todo.pop()
        if isinstance(x, Leaf):
            labels = tuple(ixs[x.index])
            done.append((x.index, labels, Counter(set(labels))))
        elif ready:
            b, a = done.pop(), done.pop()
            done.append(merge(a, b))
        else:
            todo += [(x, True), (x.right, False), (x.left, False)]
    return out


def parse_groups(text: str, labels: Callable[[str], tuple]) -> tuple[Tree, list[tuple]]:
    """A tree from "(ij,jk),kl"; leaves are numbered from left to right."""
    ixs: list[tuple] = []
    stack: list[list[Tree]] = [[]]
    at, expect = 0, True  # expect: an operand has to come next
    while at < len(text):
        c = text[at]
        if c == "(":
            if not expect:
                raise ValueError(f"Unexpected '(' at {at} in {text!r}")
            stack.append([])
            at += 1
        elif c == ")":
            if expect or len(stack) == 1:
                raise ValueError(f"Unexpected ')' at {at} in {text!r}")
            stack[-2].append(pair(stack.pop(), text))
            at += 1
        elif c == ",":
            if expect:
                raise ValueError(f"Empty input group at {at} in {text!r}")
            expect = True
            at += 1
        else:
            if not expect:
                raise ValueError(f"Unexpected {c!r} at {at} in {text!r}")
            end = at
            while end < len(text) and text[end] not in "(),":
                end += 1
            stack[-1].append(Leaf(len(ixs)))
            ixs.append(labels(text[at:end]))
            at, expect = end, False
    if len(stack) > 1:
        raise ValueError(f"Missing ')' in {text!r}")
    if expect:
        raise ValueError(f"Empty input group at the end of {text!r}")
    return (stack[0][0] if len(stack[0]) == 1 else pair(stack[0], text)), ixs


def pair(members: list[Tree], text: str) -> Tree:
    if len(members) != 2:
        raise ValueError(f"Each group must have exactly 2 members (binary), not {len(members)}, in {text!r}")
    return Node(*members)
