"""Reverse-mode gradients of contractions.

The tape is a list of nodes in the order in which they were computed: leaves, reductions of one
operand, contractions of two. The pass back visits them in reverse. Sum-product nodes use the
chain rule, whose terms are contractions themselves, without complex conjugation; tropical nodes
send a cell's gradient to the coordinates that won. Gradients add up by ordinary addition, and
cells without a row are 0, whatever the algebra.

A content is read by the forward pass and by the gradients of its siblings, and a gradient by those of
its operands, so plans would grow with the square of a network's depth. Values whose plan holds
STAGE_EVERY contractions or more are therefore written to the shared folder, contents as the tape is made and gradients
on the way back: no plan holds more than a few times STAGE_EVERY, and all gradients together cost about
two passes more than the result. The tape's winners are read by both passes; persist() keeps them.

Networks of many small tensors are differentiated on arrays in one task (dense.gradients).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import STANDARD, Algebra, total
from ..functions.algebra import algebra as named
from ..plans.order import optimize
from ..plans.spec import EinsumSpec
from ..plans.tree import steps
from ..sources.tensor import TensorRel
from ..shared import stage
from . import dense
from .contract import STAGE_EVERY, Labelled, Names, enter, leave, pairwise, pairwise_argmax, prepared, product, reduce_argmax, reduce_to


@dataclass
class TapeNode:
    """content: the value with distinct labels; args: numbers of the nodes it comes from."""

    content: Labelled
    args: tuple[int, ...] = ()
    winners: DataFrame | None = None
    inner: tuple = ()
    operand: int | None = None
    #: Contractions in the content's plan since the last staged table.
    weight: int = 0


@dataclass
class EinsumGradient:
    """Gradients of one contraction with respect to its operands."""

    spec: EinsumSpec
    names: Names
    algebra: Algebra
    nodes: list[TapeNode] = field(default_factory=list)
    shapes: list[tuple] = field(default_factory=list)
    scaled: bool = False

    def persist(self) -> EinsumGradient:
        for n in self.nodes:
            if n.winners is not None:
                n.winners.persist()
        return self

    def close(self) -> None:
        for n in self.nodes:
            if n.winners is not None:
                n.winners.unpersist()

    def backward(self, dy: TensorRel, tensors: Sequence[TensorRel]) -> list[TensorRel]:
        """One gradient for each operand, with its shape; dy is that of the result."""
        if len(tensors) != len(self.shapes):
            raise ValueError(f"{len(tensors)} tensors for {len(self.shapes)} operands")
        for i, (t, shape) in enumerate(zip(tensors, self.shapes, strict=True)):
            if t.shape != shape:
                raise ValueError(f"operand {i} had shape {list(shape)}, not {list(t.shape)}")
        out_shape = tuple(self.names.sizes[c] for c in self.spec.iy)
        if dy.shape != out_shape:
            raise ValueError(f"the gradient has shape {list(dy.shape)}, the result {list(out_shape)}")
        names = self.names
        root = len(self.nodes) - 1
        # the root's labels from the result's: sums over repeated axes, the diagonal of embedded ones
        found: dict[int, tuple[Labelled, int]] = {root: (self.spread(enter(dy, self.spec.iy, names), self.nodes[root].content.labels, of_root=True), 0)}
        grads: list[TensorRel | None] = [None] * len(tensors)
        for i in range(root, -1, -1):
            node, (g, weight) = self.nodes[i], found.pop(i)
            if node.operand is not None:
                ix = self.spec.ixs[node.operand]
                grads[node.operand] = leave(g, ix, names, STANDARD)
                continue
            g, weight = cut(g, weight)
            if len(node.args) == 1:
                found[node.args[0]] = self.one_back(node, g), weight + 1
            else:
                # a gradient's plan holds the one above and the other operand's content
                others = [self.nodes[k].weight for k in reversed(node.args)]
                found |= {k: (x, weight + 1 + w) for k, x, w in zip(node.args, self.two_back(node, g), others, strict=True)}
        return grads

    def spread(self, g: Labelled, labels: tuple, of_root: bool = False) -> Labelled:
        """g with exactly these labels: others are summed, new ones repeat the value."""
        g = reduce_to(g, labels, self.names, STANDARD)
        if set(g.labels) == set(labels):
            return g
        t = leave(g, labels, self.names, STANDARD)
        return enter(t, labels, self.names)

    def one_back(self, node: TapeNode, g: Labelled) -> Labelled:
        source = self.nodes[node.args[0]].content
        if node.winners is None:
            return self.spread(g, source.labels)
        return self.route(g, node, source.labels)

    def route(self, g: Labelled, node: TapeNode, labels: tuple) -> Labelled:
        """Send gradients to the winners, then add up over the labels that a source doesn't have."""
        names = self.names
        keys = names.columns(g.labels)
        k = F.coalesce("k", F.lit(0).cast("bigint"))
        df = g.df.join(node.winners, keys, "left") if keys else g.df.crossJoin(node.winners)
        df = names.decode(df.select(*keys, "v", k.alias("k")), "k", node.inner)
        df = df.groupBy(*names.columns(labels)).agg(total(F.col("v"), g.dtype).alias("v")) if labels else df.agg(total(F.col("v"), g.dtype).alias("v"))
        return Labelled(df, labels, g.dtype)

    def two_back(self, node: TapeNode, g: Labelled) -> tuple[Labelled, Labelled]:
        x, y = (self.nodes[i].content for i in node.args)
        names = self.names
        if node.winners is None:
            return self.spread(pairwise(g, y, x.labels, names, STANDARD), x.labels), self.spread(pairwise(x, g, y.labels, names, STANDARD), y.labels)
        if not self.scaled:
            return self.route(g, node, x.labels), self.route(g, node, y.labels)
        every = tuple(dict.fromkeys([*x.labels, *y.labels]))
        at = self.route(g, node, every)
        of = lambda z, other: reduce_to(product(at, other, names, STANDARD), z.labels, names, STANDARD)
        return of(x, y), of(y, x)


def cut(x: Labelled, weight: int) -> tuple[Labelled, int]:
    """x, written to the shared folder if its plan has become long."""
    return (Labelled(stage(x.df, "gradients"), x.labels, x.dtype), 0) if weight >= STAGE_EVERY else (x, weight)


def tape(spec: EinsumSpec, tensors: Sequence[TensorRel], a: Algebra, scaled: bool = False) -> tuple[TensorRel, EinsumGradient]:
    """Compute the result and record what the pass back needs."""
    spec, names = prepared(spec, tensors, a)
    if spec.tree is None:
        spec = optimize(spec)
    grad = EinsumGradient(spec, names, a, shapes=[t.shape for t in tensors], scaled=scaled)
    nodes = grad.nodes
    number: dict[int, int] = {}

    def add(node: TapeNode) -> int:
        nodes.append(node)
        return len(nodes) - 1

    def reduced(i: int, keep) -> int:
        x = nodes[i].content
        if all(c in keep for c in x.labels):
            return i
        weight = nodes[i].weight
        if not a.needs_argmax:
            return add(TapeNode(reduce_to(x, keep, names, a), (i,), weight=weight))
        y, winners, inner = reduce_argmax(x, keep, names, a)
        return add(TapeNode(y, (i,), winners, inner, weight=weight))

    for i, (t, ix) in enumerate(zip(tensors, spec.ixs, strict=True)):
        number[i] = add(TapeNode(enter(t, ix, names), operand=i))
    for s in steps(spec.tree, spec.ixs, spec.iy) if len(tensors) > 1 else []:
        i, j = number[s.left], number[s.right]
        keep = set(s.labels)
        i = reduced(i, keep | set(nodes[j].content.labels))
        j = reduced(j, keep | set(nodes[i].content.labels))
        x, y = nodes[i].content, nodes[j].content
        weight = nodes[i].weight + nodes[j].weight + 1
        if a.needs_argmax:
            z, winners, inner = pairwise_argmax(x, y, s.labels, names, a)
            if weight >= STAGE_EVERY:  # both come from one table
                both = stage(z.df.join(winners, names.columns(z.labels)) if z.labels else z.df.crossJoin(winners), "tape")
                z, winners, weight = Labelled(both.drop("k"), z.labels, z.dtype), both.drop("v"), 0
            number[s.out] = add(TapeNode(z, (i, j), winners, inner, weight=weight))
        else:
            z, weight = cut(pairwise(x, y, s.labels, names, a), weight)
            number[s.out] = add(TapeNode(z, (i, j), weight=weight))
    reduced(len(nodes) - 1 if len(tensors) > 1 else 0, set(spec.iy))
    return leave(nodes[-1].content, spec.iy, names, a), grad


def einsum_with_grad(spec: EinsumSpec | str, *tensors: TensorRel, algebra: str | Algebra = STANDARD, sizes=None, scaled: bool = False) -> tuple[TensorRel, EinsumGradient]:
    """The result, and the gradient whose backward(dy, tensors) gives one tensor for each operand.

    scaled multiplies the gradients of the max-times algebra by the other factor; by default they
    are sent to the winner as they are.
    """
    a = named(algebra)
    spec, _ = prepared(spec, tensors, a, sizes)
    return tape(spec, tensors, a, scaled)


def cost_and_gradient(spec: EinsumSpec | str, tensors: Sequence[TensorRel], dy: TensorRel | None = None, algebra: str | Algebra = STANDARD, sizes=None, strategy: str = "auto") -> tuple[TensorRel, list[TensorRel]]:
    """The result and all gradients; without dy the result must be a scalar, whose gradient is the number 1.

    strategy: "relational" by joins; "dense" on arrays in one task; "auto" takes the latter for
    sum-product networks of many small tensors.
    """
    a = named(algebra)
    spec, names = prepared(spec, tensors, a, sizes)
    shape = [names.sizes[c] for c in spec.iy]
    if dy is None:
        if shape:
            raise ValueError("a gradient of the result is needed unless it is a scalar")
        dy = TensorRel.scalar(tensors[0].df.sparkSession, 1, tensors[0].dtype)
    if strategy not in ("auto", "relational", "dense"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy != "relational":
        tree = spec if spec.tree else optimize(spec)
        if strategy == "dense" or dense.suits(tree, tensors, a) and dense.holds_all(tree, a):
            if list(dy.shape) != shape:
                raise ValueError(f"the gradient has shape {list(dy.shape)}, the result {shape}")
            return dense.execute(tree, tensors, a), dense.gradients(tree, tensors, dy, a)
    out, grad = tape(spec, tensors, a)
    return out, grad.backward(dy, tensors)


def contract_binary_backward(a_: TensorRel, b_: TensorRel, ia: Sequence, ib: Sequence, iy: Sequence, dy: TensorRel, algebra: str | Algebra = STANDARD, sizes=None) -> tuple[TensorRel, TensorRel]:
    """Gradients of one contraction of two tensors."""
    _, grad = einsum_with_grad(EinsumSpec((tuple(ia), tuple(ib)), tuple(iy)), a_, b_, algebra=algebra, sizes=sizes)
    ga, gb = grad.backward(dy, [a_, b_])
    return ga, gb
