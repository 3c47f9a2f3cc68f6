"""Slices against whole contractions."""

import math

import numpy as np
import pytest

from tensorloom.operators import contract as C
from tensorloom.operators import dense, sliced
from tensorloom.plans.order import complexity, optimize
from tensorloom.plans.slicing import fixed, slice_labels, slices
from tensorloom.plans.spec import EinsumSpec, parse
from tensorloom.sources.json_io import chord_network
from tensorloom.sources.tensor import TensorRel


def random_tensors(spark, spec, kind="f64", seed=0, empty=0.0, size=3):
    rng = np.random.default_rng(seed)
    labels = dict.fromkeys(c for x in spec.ixs for c in x)
    sizes = {c: size + i % 2 for i, c in enumerate(labels)}
    arrays = []
    for ix in spec.ixs:
        a = rng.integers(1, 6, [sizes[c] for c in ix]).astype(float)
        a[rng.random(a.shape) < empty] = 0
        arrays.append(a + 1j * np.round(rng.random(a.shape), 1) if kind.startswith("c") else a)
    ts = [TensorRel.from_data(spark, a.reshape(-1, order="F").tolist(), a.shape, kind) for a in arrays]
    return arrays, [TensorRel(t.df.where("v <> 0"), t.shape, t.dtype) if not kind.startswith("c") else t for t in ts]


def test_labels_are_fixed_until_everything_fits():
    spec = optimize(chord_network(101))
    whole = complexity(spec)
    for bits in (14, 12, 9, 5):
        labels = slice_labels(spec, 1 << bits)
        one = complexity(fixed(spec, labels))
        assert one.sc <= bits and len(set(labels)) == len(labels)
        assert slices(spec, labels) >= 2 ** (whole.sc - bits)
    assert slice_labels(spec, 1 << int(whole.sc)) == ()
    assert set(slice_labels(parse("ij->ij").bind([(4, 5)]), 4)) == {"j"}


PATTERNS = ["ab,bc,cd,da->", "ab,bc,ca->ab", "ab,bc,cd->da", "aab,bc,cd->ad", "ab,bc->abc", "ab,bc,cd,de,ea,ac->bd", "a,a,ab->b", "ab,cd->dbac", "ab,bc->ca", "ab,b,bc->aac"]


@pytest.mark.parametrize("text", PATTERNS)
@pytest.mark.parametrize("cells", [4, 16])
def test_sum_product(spark, text, cells):
    spec = parse(text)
    arrays, ts = random_tensors(spark, spec, empty=0.3)
    plain = EinsumSpec(spec.ixs, tuple(dict.fromkeys(spec.iy)))
    got = sliced.execute(spec, ts, cells=cells)
    want = C.einsum(text, *ts, strategy="relational")
    assert got.shape == want.shape and got.to_list() == pytest.approx(want.to_list())
    if plain.iy == spec.iy:
        assert got.to_list() == pytest.approx(np.einsum(text, *arrays).reshape(-1, order="F").tolist())


@pytest.mark.parametrize("algebra", ["maxplus", "minplus", "maxmul"])
@pytest.mark.parametrize("text", ["ab,bc,cd,da->", "ab,bc,cd->da", "ab,bc,ca->c"])
def test_tropical(spark, algebra, text):
    spec = parse(text)
    _, ts = random_tensors(spark, spec, empty=0.4, seed=3)
    got, want = sliced.execute(spec, ts, algebra, cells=6), C.einsum(text, *ts, algebra=algebra, strategy="relational")
    assert got.to_list(algebra) == want.to_list(algebra)


@pytest.mark.parametrize("kind", ["c64", "f32", "c32"])
def test_types(spark, kind):
    arrays, ts = random_tensors(spark, parse("ab,bc,ca->b"), kind)
    got = sliced.execute(parse("ab,bc,ca->b"), ts, cells=4)
    assert got.dtype.name == kind and got.to_list() == pytest.approx(np.einsum("ab,bc,ca->b", *arrays).tolist())


def test_given_labels_and_errors(spark):
    arrays, ts = random_tensors(spark, parse("ab,bc->ac"))
    for labels in ("", "a", "b", "abc", "ca"):
        got = sliced.execute(parse("ab,bc->ac"), ts, labels=tuple(labels))
        assert got.to_list() == pytest.approx((arrays[0] @ arrays[1]).reshape(-1, order="F").tolist())
    with pytest.raises(ValueError, match="floating point"):
        sliced.execute(parse("ab,bc->ac"), [TensorRel.from_data(spark, [1] * 4, [2, 2], "i64")] * 2)


def test_operands_without_cells(spark):
    t = TensorRel.from_data(spark, [1.0, 2, 3, 4], [2, 2])
    none = TensorRel(t.df.where("v > 9"), [2, 2])
    assert sliced.execute(parse("ab,bc->ac"), [t, none], cells=2).df.collect() == []
    assert sliced.execute(parse("ab,bc->"), [t, none], cells=2).to_list() == [0.0]
    assert sliced.execute(parse("ab,bc->"), [t, none], "maxplus", cells=2).df.count() == 1


def test_scalars_and_repeated_operands(spark):
    k = TensorRel.scalar(spark, 3.0)
    t = TensorRel.from_data(spark, [1.0, 2, 3, 4], [2, 2])
    got = sliced.execute(EinsumSpec(((), ("a", "b"), ("b", "a")), ("a",)), [k, t, t], cells=2)
    assert got.to_list() == [21.0, 66.0]


def test_no_task_holds_more_than_the_bound(spark, tmp_path):
    """Arrays of all tasks, measured where they are made: a network of 148 tensors in batches of slices."""
    spec = optimize(chord_network(101))
    cells = 1 << 10
    assert complexity(spec).sc > 12
    edge = TensorRel.from_data(spark, [0.5, 1.0, 0.25, 0.75], [2, 2], "f64")
    labels = slice_labels(spec, cells)
    assert math.log2(cells) >= complexity(fixed(spec, labels)).sc
    got = sliced.execute(spec, [edge] * len(spec.ixs), cells=cells).to_list()
    want = dense.evaluate(spec, [np.array([[0.5, 0.25], [1.0, 0.75]])] * len(spec.ixs), "standard", 0.0)
    assert got == pytest.approx([float(want)])


def test_batches_share_blocks():
    spec = optimize(parse("ab,bc,cd->ad").with_sizes({c: 8 for c in "abcd"}))
    ops = [sliced.operand(0, ix, spec, ("b", "c")) for ix in spec.ixs]
    assert [o.blocks for o in ops] == [8, 64, 8] and [o.shape for o in ops] == [(8,), (), (8,)]
    assert sliced.batch_size(ops, 64, 1 << 20, 4) == 16
    assert sliced.batch_size(ops, 64, 8 * 2 + 2 + 8 * 2, 4) == 2
    d = sliced.digits_of(np.arange(64), [8, 8])
    assert sorted({tuple(x) for x in d.tolist()}) == [(b, c) for b in range(8) for c in range(8)]


def test_einsum_takes_slices_where_arrays_are_too_large(spark, monkeypatch):
    spec = optimize(chord_network(13))
    edge = TensorRel.from_data(spark, [0.5, 1.0, 0.25, 0.75], [2, 2], "f64")
    ts = [edge] * len(spec.ixs)
    want = C.einsum(spec, *ts, strategy="relational").to_list()
    calls = []
    monkeypatch.setattr(sliced, "execute", lambda *a, of=sliced.execute, **k: (calls.append(1), of(*a, **k))[1])
    assert C.einsum(spec, *ts).to_list() == pytest.approx(want) and not calls
    monkeypatch.setattr(dense, "CELLS", 64)
    assert C.einsum(spec, *ts, strategy="sliced").to_list() == pytest.approx(want) and calls
