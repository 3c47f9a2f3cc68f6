"""Literal values of FIXTURES.md, on both strategies."""

import json
from pathlib import Path

import pytest

from tensorloom.operators.autodiff import einsum_with_grad
from tensorloom.operators.contract import einsum
from tensorloom.sources.tensor import TensorRel

ROWS = [json.loads(x) for x in (Path(__file__).parent.parent / "FIXTURES.md").read_text().splitlines() if x.startswith('{"id"')]
FORWARD = [x for x in ROWS if "out" in x]
BACKWARD = [x for x in ROWS if "grads" in x]


def numbers(data):
    return [float(x) for x in data]


def inputs(spark, case):
    return [TensorRel.from_data(spark, numbers(d), s) for s, d in case["in"]]


@pytest.mark.parametrize("case", FORWARD, ids=lambda x: x["id"])
def test_forward(spark, case):
    for strategy in ("relational", "dense"):
        out = einsum(case["spec"], *inputs(spark, case), algebra=case["alg"], sizes=case.get("sizes"), strategy=strategy)
        assert list(out.shape) == case["out"][0]
        assert out.to_list(case["alg"]) == numbers(case["out"][1])


@pytest.mark.parametrize("case", BACKWARD, ids=lambda x: x["id"])
def test_gradient(spark, case):
    ts = inputs(spark, case)
    out, grad = einsum_with_grad(case["spec"], *ts, algebra=case["alg"])
    dy = TensorRel.from_data(spark, numbers(case["seed"]), out.shape)
    assert [g.to_list() for g in grad.backward(dy, ts)] == [numbers(g) for g in case["grads"]]
