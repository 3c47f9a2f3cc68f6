"""Gradients by finite differences and by enumeration."""

import math
import numpy as np
import pytest

from tensorloom.operators.autodiff import contract_binary_backward, cost_and_gradient, einsum_with_grad
from tensorloom.plans.spec import parse
from tensorloom.sources.tensor import TensorRel


def flat(a):
    return np.asarray(a).reshape(-1, order="F").tolist()


@pytest.mark.parametrize("text", ["ij,jk->ik", "ij,jk,kl->il", "ii->", "ij->j", "i,j->ij", "ij,jk,ki->", "i,i,i->", "ii,ij->j", "ij,k->i", "i->ii", "ab,ab,bc->ca", "ij,jj->i"])
def test_against_finite_differences(spark, text):
    spec = parse(text)
    rng = np.random.default_rng(2)
    sizes = {c: 2 + i % 2 for i, c in enumerate(dict.fromkeys(c for x in spec.ixs for c in x))}
    arrays = [rng.random([sizes[c] for c in ix]) for ix in spec.ixs]
    ts = [TensorRel.from_data(spark, flat(a), a.shape) for a in arrays]
    f = lambda xs: np.einsum(text, *xs) if text != "i->ii" else np.diag(xs[0])
    seed = rng.random(f(arrays).shape)
    out, grad = einsum_with_grad(text, *ts)
    got = grad.backward(TensorRel.from_data(spark, flat(seed), seed.shape), ts)
    assert out.to_list() == pytest.approx(flat(f(arrays)))
    for k, a in enumerate(arrays):
        want = np.zeros_like(a)
        for at in np.ndindex(a.shape):
            up, down = ([x.copy() for x in arrays] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            want[at] = ((f(up) - f(down)) * seed).sum() / 2e-5
        assert got[k].to_list() == pytest.approx(flat(want), abs=1e-6)


@pytest.mark.parametrize("name", ["maxplus", "minplus"])
def test_tropical_chain(spark, name):
    rng = np.random.default_rng(4)
    arrays = [rng.permutation(9).reshape(3, 3) * 10**k for k in range(3)]
    ts = [TensorRel.from_data(spark, flat(a), a.shape, "i64") for a in arrays]
    out, grad = einsum_with_grad("ij,jk,kl->il", *ts, algebra=name)
    got = grad.persist().backward(TensorRel.from_data(spark, [1] * 9, [3, 3], "i64"), ts)
    want = [np.zeros((3, 3)) for _ in arrays]
    best = max if name == "maxplus" else min
    for i in range(3):
        for m in range(3):
            _, j, k = best((arrays[0][i, j] + arrays[1][j, k] + arrays[2][k, m], j, k) for j in range(3) for k in range(3))
            for w, at in zip(want, ((i, j), (j, k), (k, m)), strict=True):
                w[at] += 1
    assert [g.to_list() for g in got] == [flat(w) for w in want]
    grad.close()


def test_scalar_seed_is_one(spark):
    t = TensorRel.from_data(spark, [1.0, 2.0, 3.0], [3])
    out, (ga, gb) = cost_and_gradient("i,i->", [t, t])
    assert (out.item(), ga.to_list(), gb.to_list()) == (14.0, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])
    _, (g,) = cost_and_gradient("i->", [t], algebra="maxplus")
    assert g.to_list() == [0.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        cost_and_gradient("i->i", [t])


def test_max_times_routes_or_scales(spark):
    a, b = (TensorRel.from_data(spark, x, [2]) for x in ([2.0, 3.0], [5.0, 7.0]))
    one = TensorRel.scalar(spark, 1.0)
    for scaled, want in ((False, ([0.0, 1.0], [0.0, 1.0])), (True, ([0.0, 7.0], [0.0, 3.0]))):
        _, grad = einsum_with_grad("i,i->", a, b, algebra="maxmul", scaled=scaled)
        assert tuple(g.to_list() for g in grad.backward(one, [a, b])) == want


def test_complex_gradients_are_not_conjugated(spark):
    z = TensorRel.from_data(spark, [1 + 2j, 3 - 1j], [2], "c64")
    _, (ga, gb) = cost_and_gradient("i,i->", [z, z])
    assert ga.to_list() == gb.to_list() == [1 + 2j, 3 - 1j]


def test_mismatches(spark):
    t = TensorRel.from_data(spark, [1.0, 2.0], [2])
    _, grad = einsum_with_grad("i,i->i", t, t)
    for dy, ts in ((TensorRel.scalar(spark, 1.0), [t, t]), (t, [t]), (t, [t, TensorRel.scalar(spark, 1.0)])):
        with pytest.raises(ValueError):
            grad.backward(dy, ts)


def test_binary_backward(spark):
    a = TensorRel.from_data(spark, [1, 2, 3, 4], [2, 2], "i64")
    ones = TensorRel.from_data(spark, [1] * 4, [2, 2], "i64")
    ga, gb = contract_binary_backward(a, a, "ij", "jk", "ik", ones)
    assert (ga.to_list(), gb.to_list()) == ([4, 4, 6, 6], [3, 7, 3, 7])


def deep_chain(spark, n, size=3):
    """A chain of n matrices between two vectors, of small whole numbers as floats, and its arrays."""
    import numpy as np

    from tensorloom.plans.spec import EinsumSpec
    from tensorloom.plans.tree import left_deep

    rng = np.random.default_rng(n)
    arrays = [rng.integers(0, 3, [size] * (1 if i in (0, n + 1) else 2)).astype(float) / 2 for i in range(n + 2)]
    spec = EinsumSpec(((0,), *((i, i + 1) for i in range(n)), (n,)), ()).with_tree(left_deep(n + 2))
    return spec, arrays, [TensorRel.from_data(spark, a.reshape(-1, order="F").tolist(), a.shape) for a in arrays]


def chain_gradients(arrays):
    import numpy as np

    up, down = [arrays[0]], [arrays[-1]]
    for m in arrays[1:-1]:
        up.append(up[-1] @ m)
    for m in arrays[-2:0:-1]:
        down.append(m @ down[-1])
    down = down[::-1]
    return [down[0], *(np.outer(up[i], down[i + 1]) for i in range(len(arrays) - 2)), up[-1]]


def plan_size(df):
    return df._jdf.queryExecution().analyzed().toString().count("Join")


def test_plans_of_gradients_stay_short(spark):
    """With the depth of the tree neither the joins of one gradient grow nor, but in proportion, those of all."""
    from tensorloom.operators.autodiff import cost_and_gradient

    most, total = [], []
    for n in (8, 24):
        spec, arrays, ts = deep_chain(spark, n)
        _, grads = cost_and_gradient(spec, ts, strategy="relational")
        sizes = [plan_size(g.df) for g in grads]
        most.append(max(sizes))
        total.append(sum(sizes) / n)
        if n == 8:
            for g, want in zip(grads, chain_gradients(arrays), strict=True):
                assert g.to_list() == pytest.approx(want.reshape(-1, order="F").tolist())
    assert most[1] <= 30 and total[1] <= 1.5 * max(total[0], 8)


def test_tropical_gradients_of_a_deep_chain(spark):
    from tensorloom.operators.autodiff import cost_and_gradient

    spec, arrays, ts = deep_chain(spark, 9)
    out, grads = cost_and_gradient(spec, ts, algebra="maxplus")
    picked = [[(i, x) for i, x in enumerate(g.to_list()) if x] for g in grads]
    assert all(len(p) == 1 and p[0][1] == 1 for p in picked)  # one winning path
    assert sum(a.reshape(-1, order="F")[p[0][0]] for a, p in zip(arrays, picked, strict=True)) == pytest.approx(out.item("maxplus"))


def test_gradients_on_arrays(spark):
    """All operands of a network of 75 tensors from one task, against the definition."""
    import numpy as np

    from tensorloom.operators.autodiff import cost_and_gradient
    from tensorloom.sources.json_io import regular_network

    spec = regular_network(50)
    edge = TensorRel.from_data(spark, [0.5, 1.0, 0.25, 0.75], [2, 2])
    out, grads = cost_and_gradient(spec, [edge] * 75)
    assert len(grads) == 75
    of = np.array([[0.5, 0.25], [1.0, 0.75]])
    for g in (grads[0], grads[40], grads[74]):  # each operand's gradient with the operand gives the result
        assert sum(np.multiply(g.to_list(), of.reshape(-1, order="F"))) == pytest.approx(out.item())


@pytest.mark.parametrize("text,seed", [("ij,jk->ik", "ik"), ("ii,ij->j", "j"), ("ij,kl->ik", "ik"), ("i,ij,jk,k->", ""), ("ij,jk->iki", "iki"), ("ij->jj", "jj"), ("aab,bc,cd->ad", "ad")])
@pytest.mark.parametrize("kind", ["f64", "c64"])
def test_arrays_and_joins_agree(spark, text, seed, kind):
    import numpy as np

    from tensorloom.operators.autodiff import cost_and_gradient
    from tensorloom.plans.spec import parse

    spec = parse(text)
    rng = np.random.default_rng(5)
    sizes = {c: 2 + k for k, c in enumerate(dict.fromkeys(c for x in spec.ixs for c in x))}
    of = lambda ix: TensorRel.from_data(spark, (rng.integers(-3, 4, [math.prod(sizes[c] for c in ix)]) * (1 + (2j if kind == "c64" else 0))).tolist(), [sizes[c] for c in ix], kind)
    ts, dy = [of(ix) for ix in spec.ixs], of(spec.iy)
    a, b = (cost_and_gradient(text, ts, dy, strategy=s)[1] for s in ("dense", "relational"))
    for x, y in zip(a, b, strict=True):
        assert x.shape == y.shape and x.to_list() == pytest.approx(y.to_list())
