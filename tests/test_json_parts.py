"""Documents that tasks read and write."""

import json

import numpy as np
import pytest

from tensorloom.cli import main
from tensorloom.sources import json_io
from tensorloom.sources import json_parts as J
from tensorloom.sources.tensor import TensorRel


def whole(path):
    """A folder of parts as the document it is."""
    return json.loads("".join(p.read_text() for p in sorted(path.iterdir()) if p.name.startswith("part-")))


def array(rng, shape, kind):
    a = np.round(rng.standard_normal(shape) * 10.0 ** rng.integers(-12, 12, shape), 3)
    return a + 1j * np.round(rng.standard_normal(shape), 2) if kind.startswith("c") else a


@pytest.mark.parametrize("kind", ["f64", "c64", "f32"])
@pytest.mark.parametrize("order", ["col_major", "row_major"])
def test_round_trip(spark, tmp_path, monkeypatch, kind, order):
    monkeypatch.setattr(J, "PART", 50)
    rng = np.random.default_rng(1)
    arrays = [array(rng, s, kind) for s in ((13, 17), (3, 4, 5), (), (1,), (2, 1))]
    ts = [TensorRel.from_data(spark, a.reshape(-1, order="F").tolist(), a.shape, kind) for a in arrays]
    folder = tmp_path / "t"
    J.write_tensors(str(folder), ts, order)
    doc = whole(folder)
    assert (doc["dtype"], doc["order"], [x["shape"] for x in doc["tensors"]]) == (kind, order, [list(a.shape) for a in arrays])
    got, found = json_io.read_tensors(spark, str(folder))
    assert found == order and [t.dtype.name for t in got] == [kind] * 5
    for t, a in zip(got, arrays, strict=True):
        assert t.shape == a.shape and t.to_list() == pytest.approx(a.reshape(-1, order="F").tolist(), rel=1e-6 if kind == "f32" else 1e-15)
    assert len([p for p in folder.iterdir() if p.name.startswith("part-")]) > 3


@pytest.mark.parametrize("indent", [None, 1])
def test_files_are_split_anywhere(spark, tmp_path, indent):
    """Tasks of 300 bytes each, numbers and structure cut at any place."""
    rng = np.random.default_rng(2)
    data = np.round(rng.standard_normal(700), 4).tolist()
    doc = {"tensors": [{"data": data, "shape": [7, 100]}, {"shape": [2, 3], "data": [float("nan"), 1, -2e-3, 1e22, float("-inf"), 0]}, {"shape": [], "data": [4]}], "dtype": "f64"}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=indent))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c, v in zip(old, ("300", "0"), strict=True):
        spark.conf.set(c, v)
    try:
        got, order = json_io.read_tensors(spark, str(tmp_path / "t.json"))
        assert order == "col_major" and got[0].to_list() == data
        assert [str(x) for x in got[1].to_list()] == ["nan", "1.0", "-0.002", "1e+22", "-inf", "0.0"] and got[2].to_list() == [4.0]
        assert J.pieces(spark, str(tmp_path / "t.json")).selectExpr("count(*)", "count(distinct pos)", "min(pos)", "max(pos)").collect()[0] == ((n := len(json.dumps(doc, indent=indent).split(","))), n, 0, n - 1)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_the_driver_gets_structure_alone(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"dtype": "f64", "tensors": [{"shape": [5000], "data": list(range(5000))}]}))
    d = J.Document(spark, str(tmp_path / "t.json"))
    first, stretch, last = d.doc["tensors"][0]["data"]
    assert (first, last) == (0, 4999) and stretch.end - stretch.start == 4998
    assert d.tensor(d.doc["tensors"][0], "f64", "col_major").get(4321) == 4321
    with pytest.raises(ValueError, match="short one"):
        d.small(d.doc["tensors"][0]["data"])


@pytest.mark.parametrize("text,match", [("[1, 2]", "object"), ("{\"a\": [1, 2}", "isn't JSON"), ("", "isn't JSON"), ("{\"a\": 1", "isn't JSON")])
def test_what_is_no_document(spark, tmp_path, text, match):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(ValueError, match=match):
        J.Document(spark, str(tmp_path / "t.json"))


def test_lengths_and_shapes_are_checked(spark, tmp_path):
    for shape, data in (([3], [1, 2]), ([2, 2], [1, 2, 3, 4, 5]), ([], [])):
        (tmp_path / "t.json").write_text(json.dumps({"dtype": "f64", "tensors": [{"shape": shape, "data": data}]}))
        with pytest.raises(ValueError, match="doesn't match shape"):
            json_io.read_tensors(spark, str(tmp_path / "t.json"))


def test_commands_over_folders(spark, tmp_path):
    rng = np.random.default_rng(3)
    a, b, dy = rng.integers(0, 5, (6, 4)).astype(float), rng.integers(0, 5, (4, 3)).astype(float), rng.integers(0, 5, (6, 3)).astype(float)
    of = lambda x: TensorRel.from_data(spark, x.reshape(-1, order="F").tolist(), x.shape)
    at = lambda x: str(tmp_path / x)
    J.write_tensors(at("t"), [of(a), of(b)], "row_major")
    J.write_result(at("dy"), of(dy), "row_major")
    assert main(["contract", at("t"), "--expr", "ij,jk->ik", "--parts", "-o", at("out")]) == 0
    assert whole(tmp_path / "out") == {"dtype": "f64", "order": "row_major", "shape": [6, 3], "data": (a @ b).reshape(-1).tolist()}
    assert main(["autodiff", at("t"), "--expr", "ij,jk->ik", "--grad-output", at("dy"), "--parts", "-o", at("grads")]) == 0
    doc = whole(tmp_path / "grads")
    assert doc["result"]["data"] == (a @ b).reshape(-1).tolist()
    assert [g["data"] for g in doc["gradients"]] == [(dy @ b.T).reshape(-1).tolist(), (a.T @ dy).reshape(-1).tolist()] and [g["input_index"] for g in doc["gradients"]] == [0, 1]
    assert main(["contract", at("t"), "--expr", "ij,jk->ik", "--parts"]) == 1  # no folder named


def test_pieces_are_numbered_without_moving_them(spark, tmp_path):
    """Only the counts by range of bytes are shuffled or sorted, never the pieces."""
    (tmp_path / "t.json").write_text(json.dumps({"data": list(range(500))}))
    d = J.pieces(spark, str(tmp_path / "t.json"))
    assert [r["pos"] for r in d.orderBy("pos").collect()] == list(range(500))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Join" in plan
