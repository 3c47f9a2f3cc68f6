"""Parsing, trees, orders and costs: no Spark needed."""

import functools
import itertools
import random

import pytest

from tensorloom.plans.order import complexity, greedy, optimize, tree_sa
from tensorloom.plans.spec import EinBuilder, EinsumSpec, infer_sizes, label_ids, parse
from tensorloom.plans.sql import flat_sql
from tensorloom.plans.tree import Leaf, Node, left_deep, steps


def test_flat_expressions():
    assert parse("ij,jk->ik").ixs == (("i", "j"), ("j", "k"))
    assert parse(" ij , jk -> ik ") == parse("ij,jk->ik")
    assert parse("ii->").iy == ()
    assert not parse("ij->ji").is_optimized
    assert str(parse("ij,jk->ik")) == "ij,jk->ik"
    assert label_ids(parse("kj,ji->ki")) == {"k": 0, "j": 1, "i": 2}


def test_groups_fix_the_tree():
    assert parse("(ij,jk),kl->il").tree == Node(Node(Leaf(0), Leaf(1)), Leaf(2))
    assert parse("ij,(jk,kl)->il").tree == Node(Leaf(0), Node(Leaf(1), Leaf(2)))
    assert parse("((ij,jk),(kl,lm))->im").tree == Node(Node(Leaf(0), Leaf(1)), Node(Leaf(2), Leaf(3)))


@pytest.mark.parametrize("text", ["ij,jk", "IJ->I", "ij->k", "(ij,jk->ik", "(,jk),kl->il", "ij,,jk->ik", "(ij,jk,kl)->il", "ij)->ij", "i1->i", "(ij,jk),->ik", "ij->i->j", "(ij)(jk)->ik", "->"])
def test_malformed_expressions(text):
    with pytest.raises(ValueError):
        parse(text)


def test_builder():
    spec = EinBuilder().input("ij").input("jk").output("ik").size("i", 2).sizes({"j": 3, "k": 4}).build()
    assert spec == EinsumSpec((("i", "j"), ("j", "k")), ("i", "k"), {"i": 2, "j": 3, "k": 4})
    with pytest.raises(ValueError):
        EinBuilder().input("i").size("i", 1).build()
    with pytest.raises(ValueError):
        EinBuilder().input("i").output("i").build()


def test_sizes():
    assert infer_sizes([("i", "j"), ("j",)], [(2, 3), (3,)]) == {"i": 2, "j": 3}
    for ixs, shapes in (([("i", "i")], [(2, 3)]), ([("i",)], [(2, 3)]), ([("i",)], [(2,), (3,)])):
        with pytest.raises(ValueError):
            infer_sizes(ixs, shapes)
    with pytest.raises(ValueError):
        infer_sizes([("i",)], [(2,)], None, ("j",))


def test_labels_stay_until_their_last_use():
    found = steps(left_deep(3), [("i",), ("i",), ("i",)], ())
    assert [s.labels for s in found] == [("i",), ()]
    found = steps(left_deep(3), [("i", "j"), ("j", "k"), ("k", "l")], ("i", "l"))
    assert [s.labels for s in found] == [("i", "k"), ("i", "l")]


def test_trees_use_each_operand_once():
    spec = parse("ij,jk->ik")
    for tree in (Leaf(0), Node(Leaf(0), Leaf(0)), Node(Leaf(0), Leaf(2)), Node(Node(Leaf(0), Leaf(1)), Leaf(1))):
        with pytest.raises(ValueError):
            spec.with_tree(tree)


def test_greedy_takes_the_cheap_pair_first():
    spec = parse("ab,bc,cd->ad").with_sizes({"a": 100, "b": 100, "c": 2, "d": 100})
    assert greedy(spec) in (Node(Leaf(2), Node(Leaf(0), Leaf(1))), Node(Node(Leaf(0), Leaf(1)), Leaf(2)))
    assert complexity(spec.with_tree(greedy(spec))).tc < complexity(parse("ab,(bc,cd)->ad").with_sizes(spec.sizes)).tc


def test_orders_are_valid_and_seeded():
    rng = random.Random(3)
    for n in (1, 2, 3, 6, 12):
        edges = [tuple(rng.sample("abcdefgh", 2)) for _ in range(n)]
        spec = EinsumSpec(tuple(edges), (), {c: rng.randint(2, 5) for c in "abcdefgh"})
        for tree in (greedy(spec), greedy(spec, 0.5, 2.0, 1), tree_sa(spec, ntrials=2, niters=15)):
            tree.check(n)
        assert tree_sa(spec, ntrials=2, niters=15) == tree_sa(spec, ntrials=2, niters=15)
        assert complexity(spec, tree_sa(spec, ntrials=2, niters=15)).tc <= complexity(spec, greedy(spec)).tc + 1e-9


def test_tree_search_against_all_orders():
    spec = parse("ab,bc,cd,da->").with_sizes({"a": 2, "b": 9, "c": 3, "d": 7})

    def trees(items):
        if len(items) == 1:
            yield items[0]
        for i, j in itertools.combinations(range(len(items)), 2):
            rest = [x for k, x in enumerate(items) if k not in (i, j)]
            yield from trees([*rest, Node(items[i], items[j])])

    least = min(complexity(spec, t).tc for t in trees([Leaf(i) for i in range(4)]))
    assert complexity(spec, tree_sa(spec)).tc == pytest.approx(least, abs=0.2)


def test_tree_search_runs_what_was_asked_for():
    spec = parse("ab,bc,cd,da->").with_sizes({c: 3 for c in "abcd"})
    swept = []
    tree_sa(spec, ntrials=3, niters=4, betas=[0.1, 0.2, 0.7], sweeps=swept)
    assert swept == ([0.1] * 4 + [0.2] * 4 + [0.7] * 4) * 3
    swept.clear()
    tree_sa(spec, ntrials=2, niters=50, betas=[0.01 + 0.05 * i for i in range(300)], sweeps=swept)
    assert len(swept) == 2 * 50 * 300


def test_least_cost_of_the_ladder():
    """The least sum of products over all orders, by dynamic programming over sets of operands."""
    spec = parse("ab,cd,ac,bd,be,df,ef,eg,fh,gh->").with_sizes({c: 8 for c in "abcdefgh"})
    n = len(spec.ixs)
    full = (1 << n) - 1

    @functools.cache
    def open_labels(mask):
        inside = {c for i in range(n) if mask >> i & 1 for c in spec.ixs[i]}
        return frozenset(c for c in inside if any(c in spec.ixs[i] for i in range(n) if not mask >> i & 1))

    @functools.cache
    def least(mask):
        if mask & (mask - 1) == 0:
            return 0, frozenset(spec.ixs[mask.bit_length() - 1])
        best, part = None, (mask - 1) & mask
        while part:
            if part >= mask ^ part:
                (a, x), (b, y) = least(part), least(mask ^ part)
                cost = a + b + 8 ** len(x | y)
                best = cost if best is None or cost < best else best
            part = (part - 1) & mask
        return best, open_labels(mask)

    assert least(full)[0] == 6 * 8**3 + 3 * 8**2
    assert 2 ** complexity(optimize(spec, "greedy")).tc == pytest.approx(least(full)[0])


def test_unknown_methods_and_sizes():
    with pytest.raises(ValueError):
        optimize(parse("ij->i"))
    with pytest.raises(ValueError):
        optimize(parse("i->i").with_sizes({"i": 1}), "magic")


def test_flat_sql():
    sql = flat_sql(parse("ij,jk->ik"), ["a", "b"])
    assert sql == "SELECT CAST(t0.d0 AS BIGINT) AS d0, CAST(t1.d1 AS BIGINT) AS d1, CAST(SUM(t0.v * t1.v) AS BIGINT) AS v FROM a t0, b t1 WHERE t0.d1 = t1.d0 GROUP BY t0.d0, t1.d1"
