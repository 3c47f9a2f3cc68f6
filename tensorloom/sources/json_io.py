"""JSON documents of tensors, contraction topologies, results and gradients.

A tensors document holds dtype, order (col_major if absent) and tensors of shape and data, complex
data as alternating real and imaginary parts; tasks read it (json_parts). A topology holds an expression
with its tree; it is small and read on the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..plans.spec import EinsumSpec, label_ids, parse
from ..plans.tree import Leaf, Node, Tree, steps
from .json_parts import Document
from .tensor import TensorRel, strides

#: Fixed values of the document formats.
SCHEMA_VERSION = 1
ORDERS = ("col_major", "row_major")
DOCUMENT_DTYPES = ("f32", "f64", "c32", "c64")


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        try:
            x = json.load(f)
        except ValueError as e:
            raise ValueError(f"{path} isn't JSON: {e}") from None
    if not isinstance(x, dict):
        raise ValueError(f"{path} doesn't hold a JSON object")
    return x


def write_json(x: dict, path: str | None = None, pretty: bool = False) -> None:
    text = json.dumps(x, indent=2 if pretty else None)
    if path is None:
        print(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")


def checked(doc: dict) -> tuple[str, str]:
    t, order = doc.get("dtype"), doc.get("order", "col_major")
    if t not in DOCUMENT_DTYPES:
        raise ValueError(f"dtype {t!r}: expected one of {', '.join(DOCUMENT_DTYPES)}")
    if order not in ORDERS:
        raise ValueError(f"order {order!r}: expected one of {', '.join(ORDERS)}")
    return t, order


def read_tensors(spark: SparkSession, path: str) -> tuple[list[TensorRel], str]:
    """The tensors of a document, a file or a folder of parts, and its order."""
    d = Document(spark, path)
    t, order = checked(d.doc)
    return [d.tensor(x, t, order) for x in d.doc.get("tensors", [])], order


def data_of(t: TensorRel, order: str) -> list[float]:
    cells = t.to_list(order=order)
    return [x for z in cells for x in (z.real, z.imag)] if t.dtype.is_complex else cells


def result_document(t: TensorRel, order: str) -> dict:
    return {"dtype": t.dtype.name, "order": order, "shape": list(t.shape), "data": data_of(t, order)}


def gradient_document(result: TensorRel, grads: Sequence[TensorRel], order: str) -> dict:
    entry = lambda t: {"shape": list(t.shape), "data": data_of(t, order)}
    return {"dtype": result.dtype.name, "order": order, "result": entry(result), "gradients": [{"input_index": i} | entry(g) for i, g in enumerate(grads)]}


def read_seed(spark: SparkSession, path: str, t: str, order: str, shape: Sequence[int]) -> TensorRel:
    """The gradient of a result; type, order and shape must be the result's."""
    d = Document(spark, path)
    doc = d.doc
    if "tensors" in doc:
        if len(doc["tensors"]) != 1:
            raise ValueError("the gradient file must hold exactly one tensor")
        doc = {k: v for k, v in doc.items() if k != "tensors"} | doc["tensors"][0]
    own, own_order = checked(doc)
    if own != t:
        raise ValueError(f"the gradient has dtype {own}, the tensors {t}")
    if own_order != order:
        raise ValueError(f"the gradient has order {own_order}, the tensors {order}")
    if d.small(doc["shape"]) != list(shape):
        raise ValueError(f"the gradient has shape {d.small(doc['shape'])}, the result {list(shape)}")
    return d.tensor(doc, own, own_order)


def tree_document(spec: EinsumSpec, ids: dict) -> dict:
    """The tree with each node's labels by number."""
    number = lambda labels: [ids[c] for c in labels]
    found = {i: {"Leaf": {"tensor_index": i}} for i in range(len(spec.ixs))}
    todo = steps(spec.tree, spec.ixs, spec.iy) if len(spec.ixs) > 1 else []
    for i, s in enumerate(todo):
        labels = spec.iy if i + 1 == len(todo) else s.labels
        found[s.out] = {"Node": {"args": [found[s.left], found[s.right]], "eins": {"ixs": [number(s.left_labels), number(s.right_labels)], "iy": number(labels)}}}
    return found[todo[-1].out if todo else 0]


def topology_document(expression: str, spec: EinsumSpec, method: str) -> dict:
    ids = label_ids(spec)
    return {
        "schema_version": SCHEMA_VERSION,
        "expression": expression,
        "label_map": ids,
        "size_dict": {str(i): spec.sizes[c] for c, i in ids.items()},
        "method": method,
        "tree": tree_document(spec, ids),
    }


def tree_of(doc, known: set[int]) -> Tree:
    if isinstance(doc, dict) and "Leaf" in doc:
        return Leaf(int(doc["Leaf"]["tensor_index"]))
    if not isinstance(doc, dict) or "Node" not in doc:
        raise ValueError("a tree node must be a Leaf or a Node")
    node = doc["Node"]
    if len(node.get("args", [])) != 2:
        raise ValueError("tree nodes must be binary")
    eins = node.get("eins", {})
    for label in [c for x in [*eins.get("ixs", []), eins.get("iy", [])] for c in x]:
        if label not in known:
            raise ValueError(f"unknown label index {label} in the tree")
    return Node(*(tree_of(x, known) for x in node["args"]))


def read_topology(path: str) -> EinsumSpec:
    """A spec with sizes and tree from a topology document, validated."""
    doc = read_json(path)
    if doc.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"Unsupported schema_version {doc.get('schema_version')!r}: expected {SCHEMA_VERSION}")
    spec = parse(doc["expression"])
    ids = {c: int(i) for c, i in doc["label_map"].items()}
    if missing := label_ids(spec).keys() - ids.keys():
        raise ValueError(f"label_map lacks {sorted(missing)}")
    sizes = {}
    for c, i in ids.items():
        if str(i) not in doc["size_dict"]:
            raise ValueError(f"Missing size for label index {i}")
        sizes[c] = int(doc["size_dict"][str(i)])
    return spec.with_sizes(sizes).with_tree(tree_of(doc["tree"], set(ids.values())))


def network_document(spec: EinsumSpec, bond_dim: int) -> dict:
    """A network's edges and tree; labels are vertices."""
    found: dict = {i: {"isleaf": True, "tensorindex": i} for i in range(len(spec.ixs))}
    todo = steps(spec.tree, spec.ixs, spec.iy) if len(spec.ixs) > 1 else []
    for s in todo:
        found[s.out] = {"isleaf": False, "args": [found[s.left], found[s.right]], "eins": {"ixs": [list(s.left_labels), list(s.right_labels)], "iy": list(s.labels)}}
    return {"n_vertices": len(spec.sizes), "bond_dim": bond_dim, "edges": [list(x) for x in spec.ixs], "tree": found[todo[-1].out if todo else 0]}


def read_network(path: str) -> EinsumSpec:
    """A network document: one operand for each edge, whose labels are vertices, and a tree; the output is a scalar."""
    doc = read_json(path)
    ixs = [tuple(e) for e in doc["edges"]]

    def tree(x) -> Tree:
        return Leaf(int(x["tensorindex"])) if x["isleaf"] else Node(*(tree(y) for y in x["args"]))

    return EinsumSpec(tuple(ixs), (), {c: doc["bond_dim"] for e in ixs for c in e}).with_tree(tree(doc["tree"]))


def regular_network(n: int, bond_dim: int = 2) -> EinsumSpec:
    """A 3-regular network of n vertices: a ring and the chords to the opposite vertices."""
    if n % 2:
        raise ValueError("a 3-regular network has an even number of vertices")
    edges = [(i, (i + 1) % n) for i in range(n)] + [(i, i + n // 2) for i in range(n // 2)]
    return EinsumSpec(tuple(edges), (), {i: bond_dim for i in range(n)})


def chord_network(n: int, bond_dim: int = 2) -> EinsumSpec:
    """A network of n vertices, n a prime: a ring, and a chord from each vertex to its inverse modulo n.

    Such graphs expand, unlike a ring with opposite chords, so that contractions have large intermediate
    results. Vertices have degree 3, but for 0 and those that are their own inverse or a neighbour of it.
    """
    if n < 5 or any(n % k == 0 for k in range(2, math.isqrt(n) + 1)):
        raise ValueError("a chord network has a prime number of vertices, at least 5")
    pair = lambda a, b: (min(a, b), max(a, b))
    edges = {pair(i, (i + 1) % n) for i in range(n)} | {pair(i, pow(i, -1, n)) for i in range(2, n - 1)}
    return EinsumSpec(tuple(sorted(edges)), (), {i: bond_dim for i in range(n)})


def linear_of(coords: Sequence[int], shape: Sequence[int], order: str = "col_major") -> int:
    return sum(c * s for c, s in zip(coords, strides(shape, order), strict=True))
