"""Factored results against expanded ones."""

import numpy as np
import pytest

from tensorloom.operators import contract as C
from tensorloom.operators.factored import Factored, einsum, factored, groups
from tensorloom.plans.spec import parse
from tensorloom.sources.tensor import TensorRel


def make(spark, text, seed=0):
    spec = parse(text)
    rng = np.random.default_rng(seed)
    sizes = {c: 2 + i % 3 for i, c in enumerate(sorted({c for x in spec.ixs for c in x}))}
    return [TensorRel.from_data(spark, rng.integers(-3, 4, int(np.prod([sizes[c] for c in ix]))).tolist(), [sizes[c] for c in ix], "i64") for ix in spec.ixs]


@pytest.mark.parametrize("text,factors", [("ij,kl->ijkl", 2), ("i,j,k->kij", 3), ("ij,jk,l->ikl", 2), ("ij,ik->ijk", 2), ("ij,jk->ik", 1), ("i,j->iij", 2), ("ab,bc,cd->ad", 1), ("ij,k->k", 2)])
def test_expanded(spark, text, factors):
    ts = make(spark, text)
    f = factored(text, *ts)
    want = C.einsum(text, *ts)
    assert len(f.factors) == factors and f.shape == want.shape and f.expand().to_list() == want.to_list()


@pytest.mark.parametrize("algebra", ["standard", "maxplus"])
def test_contracted(spark, algebra):
    a, b, c = make(spark, "ij,kl,jk->ijkl", seed=2)
    outer = factored("ij,kl->ijkl", a, b, algebra=algebra)
    full = outer.expand()
    for text in ("ijkl,jk->il", "ijkl,jk->", "ijkl,jk->ijl"):
        assert einsum(text, outer, c, algebra=algebra).to_list(algebra) == C.einsum(text, full, c, algebra=algebra).to_list(algebra)
    with pytest.raises(ValueError, match="under"):
        einsum("ijkl,jk->il", outer, c, algebra="minplus")


def test_repeated_labels_and_two_factored_operands(spark):
    rng = np.random.default_rng(1)
    t = TensorRel.from_data(spark, rng.integers(-3, 4, 9).tolist(), [3, 3], "i64")
    outer = factored("ij,kl->ijkl", t, t)
    full = outer.expand()
    for text in ("iijk->jk", "ijjk->ik", "ijij->", "iiii->i", "ijkl->lkji"):
        assert einsum(text, outer).to_list() == C.einsum(text, full).to_list()
    assert einsum("ijkl,klmn->ijmn", outer, outer).to_list() == C.einsum("ijkl,klmn->ijmn", full, full).to_list()
    twice = factored("ijkl,mn->ijklmn", outer, t)
    assert isinstance(twice, Factored) and len(twice.factors) == 3 and twice.ndim == 6


def test_the_outer_product_is_never_made(spark):
    """Eight labels, of which six are summed: no product without a common label, and no more rows than an operand has."""
    t = TensorRel.from_data(spark, list(range(1, 17)), [4, 4], "i64")
    v = TensorRel.from_data(spark, [1, 2, 3, 4], [4], "i64")
    outer = factored("ij,kl,mn,op->ijklmnop", t, t, t, t)
    got = einsum("ijklmnop,jk,lm,no->ip", outer, t, t, t)
    plan = got.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    m = np.arange(1, 17).reshape(4, 4, order="F")
    assert got.to_list() == np.linalg.matrix_power(m, 7).reshape(-1, order="F").tolist()
    assert einsum("ijklmnop,i->p", outer, v).shape == (4,)


def test_groups():
    assert groups(parse("ij,jk,kl,m->ilm")) == [[0, 1, 2], [3]] and groups(parse("ij,kl,mi->jklm")) == [[0, 2], [1]] and groups(parse("i,i->i")) == [[0], [1]]
