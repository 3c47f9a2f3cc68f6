"""Documents in, documents out."""

import json

import numpy as np
import pytest

from tensorloom.cli import main
from tensorloom.sources import json_io


@pytest.fixture
def run(spark, tmp_path, capsys):
    def go(*args, **files):
        for name, content in files.items():
            (tmp_path / f"{name}.json").write_text(json.dumps(content))
        code = main([str(tmp_path / a) if a.endswith(".json") else a for a in args])
        out = capsys.readouterr()
        return code, json.loads(out.out) if out.out.strip() else None, out.err

    return go


def tensors(dtype, order, *entries):
    return {"dtype": dtype, "order": order, "tensors": [{"shape": s, "data": d} for s, d in entries]}


EIGHT = [2, 0, 5, 1, 3, 7, 4, 6]


@pytest.mark.parametrize("order,want", [("col_major", [23, 41, 77, 71]), ("row_major", [23, 41, 77, 71])])
def test_contract(run, order, want):
    """A matrix of 2 x 4 by one of 4 x 2, whose cells are listed in either order."""
    code, out, _ = run("contract", "t.json", "--expr", "ij,jk->ik", t=tensors("f64", order, ([2, 4], EIGHT), ([4, 2], EIGHT)))
    of = lambda *shape: np.array(EIGHT).reshape(shape, order="F" if order == "col_major" else "C")
    assert want == (of(2, 4) @ of(4, 2)).reshape(-1, order="F" if order == "col_major" else "C").tolist()
    assert code == 0 and out == {"dtype": "f64", "order": order, "shape": [2, 2], "data": want}


def test_complex_documents(run):
    _, out, _ = run("contract", "t.json", "--expr", "ii->", t=tensors("c32", "col_major", ([2, 2], [1, 1, 0, 0, 0, 0, 2, -1])))
    assert (out["shape"], out["data"]) == ([], [3, 0])
    _, out, _ = run("contract", "t.json", "--expr", "ij->ji", t=tensors("c64", "row_major", ([2, 2], [1, 1, 2, -1, 3, 0, 4, 2])))
    assert out["data"] == [1, 1, 3, 0, 2, -1, 4, 2]


def test_topology_round_trip(run, tmp_path):
    expression = "ij,jk,kl->il"
    code, _, _ = run("optimize", expression, "--sizes", "i=2,j=4,k=2,l=2", "--method", "treesa", "--ntrials", "2", "-o", "topo.json", "--pretty")
    assert code == 0
    doc = tensors("f64", "col_major", ([2, 4], EIGHT), ([4, 2], EIGHT), ([2, 2], [0, 2, 1, 0]))
    _, out, _ = run("contract", "t.json", "-t", "topo.json", t=doc)
    assert out["data"] == [154, 142, 23, 41]


def test_autodiff(run):
    _, out, _ = run("autodiff", "t.json", "--expr", "ii->", t=tensors("f64", "col_major", ([2, 2], [1, 2, 3, 4])))
    assert out["result"] == {"shape": [], "data": [5]} and out["gradients"] == [{"input_index": 0, "shape": [2, 2], "data": [1, 0, 0, 1]}]
    two = tensors("f64", "row_major", ([2, 2], [1, 2, 3, 4]), ([2, 2], [5, 6, 7, 8]))
    seed = {"dtype": "f64", "order": "row_major", "shape": [2, 2], "data": [1, 1, 1, 1]}
    _, out, _ = run("autodiff", "t.json", "--expr", "ij,jk->ik", "--grad-output", "g.json", t=two, g=seed)
    assert out["result"]["data"] == [19, 22, 43, 50]
    assert [g["data"] for g in out["gradients"]] == [[11, 15, 11, 15], [4, 4, 6, 6]]
    for change in ({"dtype": "f32"}, {"order": "col_major"}, {"shape": [4]}):
        assert run("autodiff", "t.json", "--expr", "ij,jk->ik", "--grad-output", "g.json", t=two, g=seed | change)[0] == 1
    assert run("autodiff", "t.json", "--expr", "ij,jk->ik", t=two)[0] == 1


def topology(**change):
    leaf = lambda i: {"Leaf": {"tensor_index": i}}
    node = {"Node": {"args": [leaf(0), leaf(1)], "eins": {"ixs": [[0, 1], [1, 2]], "iy": [0, 2]}}}
    return {"schema_version": 1, "expression": "ij,jk->ik", "label_map": {"i": 0, "j": 1, "k": 2}, "size_dict": {"0": 2, "1": 3, "2": 2}, "method": "greedy", "tree": node} | change


LEAF = {"Leaf": {"tensor_index": 0}}
BAD_TREES = {
    "out of range": {"Node": {"args": [LEAF, {"Leaf": {"tensor_index": 7}}], "eins": {"ixs": [[0], [1]], "iy": []}}},
    "binary": {"Node": {"args": [LEAF, LEAF, LEAF], "eins": {"ixs": [], "iy": []}}},
    "unknown label index": {"Node": {"args": [LEAF, {"Leaf": {"tensor_index": 1}}], "eins": {"ixs": [[9], [1]], "iy": []}}},
}


def test_errors(run):
    t = tensors("f64", "col_major", ([2, 4], EIGHT), ([4, 2], EIGHT))
    cases = [
        (("contract", "t.json", "-t", "x.json", "--expr", "ij,jk->ik"), topology(), "not both"),
        (("contract", "t.json"), topology(), "is needed"),
        (("optimize", "ij->i", "--sizes", "i=2,j=2", "--method", "magic"), topology(), "--method"),
        (("contract", "t.json", "-t", "x.json"), topology(schema_version=2), "schema_version"),
        (("contract", "t.json", "-t", "x.json"), topology(size_dict={"0": 2}), "Missing size for label index"),
        *((("contract", "t.json", "-t", "x.json"), topology(tree=tree), text) for text, tree in BAD_TREES.items()),
        (("optimize", "ij->i", "--sizes", "i=0,j=2"), topology(), "at least 1"),
        (("optimize", "ij->i", "--sizes", "x=2"), topology(), "has no label"),
        (("optimize", "ij->i", "--sizes", "i=2"), topology(), "no size"),
        (("optimize", "ij->i", "--sizes", "i=2,j=2", "--method", "treesa", "--betas", "1:0:2"), topology(), "step"),
        (("contract", "none.json", "--expr", "i->"), topology(), "none.json"),
    ]
    for args, x, text in cases:
        code, _, err = run(*args, t=t, x=x)
        assert code == 1 and text in err, (args, err)
    code, _, err = run("contract", "t.json", "--expr", "i->", t=tensors("f64", "col_major", ([3], [1, 2])))
    assert code == 1 and "doesn't match shape" in err
    assert run("contract", "t.json", "--expr", "i->", t=tensors("f16", "col_major", ([1], [1])))[0] == 1


def test_network_documents(tmp_path):
    leaf = lambda i: {"isleaf": True, "tensorindex": i}
    tree = {"isleaf": False, "eins": {"ixs": [[0, 1], [1, 2]], "iy": []}, "args": [leaf(0), {"isleaf": False, "args": [leaf(1), leaf(2)]}]}
    (tmp_path / "n.json").write_text(json.dumps({"n_vertices": 3, "bond_dim": 2, "edges": [[0, 1], [1, 2], [2, 0]], "tree": tree}))
    spec = json_io.read_network(str(tmp_path / "n.json"))
    assert spec.is_optimized and spec.sizes == {0: 2, 1: 2, 2: 2}
    assert len(json_io.regular_network(10).ixs) == 15
