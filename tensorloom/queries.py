"""Queries over the warehouse tables: each operator once or more, with the SQL that states its result."""

from __future__ import annotations

import contextlib
import io
import tempfile
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cli
from .functions.algebra import algebra, custom, is_zero, plus_gradient, times_gradient
from .operators import blocked, dense, hypercube, skew, sliced
from .operators import contract as C
from .operators.autodiff import contract_binary_backward, cost_and_gradient, einsum_with_grad
from .operators.factored import einsum as factored_einsum
from .operators.factored import factored
from .operators.kbest import k_best
from .plans.order import complexity, optimize
from .plans.spec import EinBuilder, EinsumSpec, parse
from .plans.sparse import by_rows
from .plans.sql import flat_sql, tree_sql
from .plans.tree import left_deep
from .shared import new_folder, ship_code
from .sources import json_io, json_parts
from .sources.json_io import chord_network, regular_network
from .sources.tensor import TensorRel

#: The base tensors as SQL over the tables, coordinates d0, d1 and integer values v.
BASE_SQL = {
    # quantity by supplier and part
    "L": "SELECT l_suppkey d0, l_partkey d1, CAST(SUM(l_quantity) AS BIGINT) v FROM lineitem GROUP BY 1, 2",
    # supplier to nation, nation to region, customer to nation
    "SN": "SELECT s_suppkey d0, s_nationkey d1, CAST(1 AS BIGINT) v FROM supplier",
    "NR": "SELECT n_nationkey d0, n_regionkey d1, CAST(1 AS BIGINT) v FROM nation",
    "CN": "SELECT c_custkey d0, c_nationkey d1, CAST(1 AS BIGINT) v FROM customer",
    # quantity from supplier's nation to customer's nation
    "G": "SELECT s_nationkey d0, c_nationkey d1, CAST(SUM(l_quantity) AS BIGINT) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    # lines by nation of the supplier, line number and nation of the customer
    "T": "SELECT s_nationkey d0, l_linenumber d1, c_nationkey d2, CAST(COUNT(*) AS BIGINT) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3",
    # events by user and type, types numbered by name
    "U": "SELECT user_id d0, k d1, CAST(COUNT(*) AS BIGINT) v FROM events JOIN (SELECT event_type AS e, ROW_NUMBER() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)) ON event_type = e GROUP BY 1, 2",
    # lines by regions and nations of supplier and customer; by line number too; by eight axes
    "Q": "SELECT sr d0, cr d1, s_nationkey d2, c_nationkey d3, CAST(COUNT(*) AS BIGINT) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT n_nationkey AS sn, n_regionkey AS sr FROM nation) ON s_nationkey = sn JOIN (SELECT n_nationkey AS cn, n_regionkey AS cr FROM nation) ON c_nationkey = cn GROUP BY ALL",
    "H": "SELECT sr d0, cr d1, l_linenumber d2, s_nationkey d3, c_nationkey d4, CAST(COUNT(*) AS BIGINT) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT n_nationkey AS sn, n_regionkey AS sr FROM nation) ON s_nationkey = sn JOIN (SELECT n_nationkey AS cn, n_regionkey AS cr FROM nation) ON c_nationkey = cn GROUP BY ALL",
    "O": "SELECT sr d0, cr d1, l_linenumber d2, CAST(l_quantity AS BIGINT) % 4 d3, l_partkey % 3 d4, l_suppkey % 3 d5, o_orderkey % 4 d6, o_custkey % 5 d7, CAST(COUNT(*) AS BIGINT) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT n_nationkey AS sn, n_regionkey AS sr FROM nation) ON s_nationkey = sn JOIN (SELECT n_nationkey AS cn, n_regionkey AS cr FROM nation) ON c_nationkey = cn GROUP BY ALL",
    "R": "SELECT sr d0, cr d1, l_linenumber % 5 d2, CAST(SUM(l_quantity) AS BIGINT) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT n_nationkey AS sn, n_regionkey AS sr FROM nation) ON s_nationkey = sn JOIN (SELECT n_nationkey AS cn, n_regionkey AS cr FROM nation) ON c_nationkey = cn GROUP BY ALL",
    # suppliers by nation, parts' size
    "b": "SELECT s_nationkey d0, CAST(COUNT(*) AS BIGINT) v FROM supplier GROUP BY 1",
    "P": "SELECT p_partkey d0, CAST(p_size AS BIGINT) v FROM part",
    "A": "SELECT s_suppkey d0, CAST(floor(s_acctbal) AS BIGINT) v FROM supplier",
    # embeddings, scaled to whole numbers
    "W": "SELECT vec_id d0, pos d1, CAST(floor(x * 10000 + 0.5) AS BIGINT) v FROM (SELECT vec_id, unnest(range(len(embedding))) pos, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings)",
    "k": "SELECT CAST(COUNT(*) AS BIGINT) v FROM region",
}

#: Name: (expression, operands, algebra, sizes of new labels).
FLAT = {
    "transpose_G": ("ij->ji", "G", "standard", None),
    "trace_G": ("ii->", "G", "standard", None),
    "diag_G": ("ii->i", "G", "standard", None),
    "diag_embed_b": ("i->ii", "b", "standard", None),
    "project_diag_G": ("ii->ii", "G", "standard", None),
    "identity_T": ("ijk->ijk", "T", "standard", None),
    "sum_all_L": ("ij->", "L", "standard", None),
    "sum_axis_L": ("ij->i", "L", "standard", None),
    "repeat_b": ("i->ij", "b", "standard", {"j": 4}),
    "repeat_prepend_b": ("i->ji", "b", "standard", {"j": 3}),
    "permute3_T": ("ijk->kij", "T", "standard", None),
    "partial_trace_T": ("iji->j", "T", "standard", None),
    "partial_trace_inner": ("ijjk->ik", "Qi", "standard", None),
    "partial_trace_transposed": ("ijjk->ki", "Qi", "standard", None),
    "multi_trace_Q": ("iijj->", "Q", "standard", None),
    "multi_trace_kept": ("iijj->j", "Q", "standard", None),
    "triple_trace_R": ("iii->", "R", "standard", None),
    "triple_diag_R": ("iii->i", "R", "standard", None),
    "rank5_pair": ("abcde,abcfg->defg", "H,H", "standard", None),
    "rank5_batched": ("abcde,abcfg->abdefg", "H,H", "standard", None),
    "rank5_maxplus": ("abcde,abcfg->defg", "H,H", "maxplus", None),
    "rank4_outer": ("ij,kl,mn,op->ijklmnop", "NR,NR,NR,NR", "standard", None),
    "rank8_pair": ("abcdefgh,ijcdefgh->abij", "O,O", "standard", None),
    "rank8_minplus": ("abcdefgh,ijcdefgh->abij", "O,O", "minplus", None),
    "multi_trace_GG": ("ii,jj->", "G,G", "standard", None),
    "maxplus_rows": ("ij->i", "G", "maxplus", None),
    "maxplus_trace": ("ii->", "G", "maxplus", None),
    "minplus_cols": ("ij->j", "G", "minplus", None),
    "maxmul_all": ("ij->", "G", "maxmul", None),
    "matmul_LLt": ("ij,kj->ik", "L,L", "standard", None),
    "matmul_nn": ("ij,jk->ik", "G,G", "standard", None),
    "matmul_tn": ("ji,jk->ik", "G,G", "standard", None),
    "matmul_tt": ("ji,kj->ik", "G,G", "standard", None),
    "matmul_out_transposed": ("ij,jk->ki", "G,G", "standard", None),
    "gram_W": ("ij,ik->jk", "W,W", "standard", None),
    "matvec": ("ij,j->i", "L,P", "standard", None),
    "vecmat": ("i,ij->j", "A,L", "standard", None),
    "dot": ("i,i->", "P,P", "standard", None),
    "frobenius": ("ij,ij->", "L,L", "standard", None),
    "hadamard": ("ij,ij->ij", "L,L", "standard", None),
    "outer": ("i,j->ij", "b,b", "standard", None),
    "scalar_mul": (",ij->ij", "k,G", "standard", None),
    "batched_matmul": ("bij,bjk->bik", "T,T3", "standard", None),
    "batched_matvec": ("bij,bj->bi", "T,G", "standard", None),
    "batched_dot": ("bi,bi->b", "G,G", "standard", None),
    "trace_scale": ("ii,jk->jk", "G,G", "standard", None),
    "diag_matmul": ("ii,ij->j", "G,G", "standard", None),
    "diag_outer": ("ii,jj->ij", "G,G", "standard", None),
    "right_repeat": ("ij,jj->i", "G,G", "standard", None),
    "batched_diag": ("ibi,ij->bij", "T,G", "standard", None),
    "multi_contract": ("ijk,ijl->kl", "T,T", "standard", None),
    "bilinear": ("i,ij,j->", "b,G,b", "standard", None),
    "chain3": ("sp,sn,nr->pr", "L,SN,NR", "standard", None),
    "chain4": ("nr,nm,ms,sp->rp", "NR,G,NS,Ls", "standard", None),
    "star3": ("ia,ib,ic->abc", "NR,NR,NR", "standard", None),
    "star_scalar": ("i,i,i->", "b,b,b", "standard", None),
    "cycle3": ("ij,jk,ki->", "G,G,G", "standard", None),
    "customers_by_region": ("cn,nr->r", "CN,NR", "standard", None),
    "khatri_rao": ("ik,jk->ijk", "G,NRt", "standard", None),
    "grid2x2": ("ab,bd,ac,cd->", "G,G,G,G", "standard", None),
    "ladder": ("ab,cd,ac,bd,be,df,ef->", "G,G,G,G,G,G,G", "standard", None),
    "tree_explicit": ("(sp,sn),nr->pr", "L,SN,NR", "standard", None),
    "region_flow": ("ij,ia,jb->ab", "G,NR,NR", "standard", None),
    "user_types": ("ua,ub->ab", "U,U", "standard", None),
    "maxplus_matmul": ("ij,jk->ik", "G,G", "maxplus", None),
    "minplus_matmul": ("ij,jk->ik", "G,G", "minplus", None),
    "maxmul_matmul": ("ij,jk->ik", "G,G", "maxmul", None),
    "minplus_2hop": ("ij,jk,kl->il", "G,G,G", "minplus", None),
    "bellman_ford_step": ("ij,j->i", "G,b", "minplus", None),
    "viterbi_step": ("i,ij,j->j", "b,G,b", "maxplus", None),
    "maxplus_chain": ("i,ij,jk,k->", "b,G,G,b", "maxplus", None),
    "maxplus_outer": ("i,j->ij", "b,b", "maxplus", None),
}

#: Views of the base tensors: name, and the order of its axes.
VIEWS = {"Qi": ("Q", (0, 2, 3, 1)), "T3": ("T", (0, 2, 1)), "NS": ("SN", (1, 0)), "Ls": ("L", (0, 1)), "NRt": ("NR", (1, 0))}
#: Sums of products of three or more cells of G exceed 64 bits on large tables, so these run on values modulo 10.
SMALL = {"ladder", "grid2x2", "cycle3"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def top(df: DataFrame, column: str) -> int:
    """One more than the largest key."""
    return tops([(df, column)])[0]


def tops(columns: list[tuple[DataFrame, str]]) -> list[int]:
    """One more than the largest key of each column, by one job."""
    found = [df.agg(F.max(column).cast("bigint").alias("n")).withColumn("i", F.lit(i)) for i, (df, column) in enumerate(columns)]
    largest = {r["i"]: r["n"] for r in reduce(DataFrame.unionAll, found).collect()}
    return [0 if largest[i] is None else largest[i] + 1 for i in range(len(columns))]


def base(spark: SparkSession, sf_dir: str, name: str) -> TensorRel:
    """A base tensor from the tables."""
    t = lambda x: table(spark, sf_dir, x)
    if name in VIEWS:
        source, axes = VIEWS[name]
        return base(spark, sf_dir, source).permute(axes)
    sizes = {"s": ("supplier", "s_suppkey"), "p": ("part", "p_partkey"), "n": ("nation", "n_nationkey"), "r": ("region", "r_regionkey"), "c": ("customer", "c_custkey"), "k": ("lineitem", "l_linenumber")}

    def shape(*of: str) -> list[int]:
        names = list(dict.fromkeys(of))
        found = dict(zip(names, tops([(t(sizes[x][0]), sizes[x][1]) for x in names]), strict=True))
        return [found[x] for x in of]

    if name == "L":
        return TensorRel.from_table(t("lineitem"), ["l_suppkey", "l_partkey"], "l_quantity", shape("s", "p"))
    if name in ("SN", "NR", "CN"):
        where, row, column, of = {"SN": ("supplier", "s_suppkey", "s_nationkey", "sn"), "NR": ("nation", "n_nationkey", "n_regionkey", "nr"), "CN": ("customer", "c_custkey", "c_nationkey", "cn")}[name]
        return TensorRel.from_table(t(where), [row, column], F.lit(1), shape(*of))
    if name in ("Q", "H", "O", "R"):
        region = lambda s: t("nation").select(F.col("n_nationkey").alias(f"{s}n"), F.col("n_regionkey").alias(f"{s}r"))
        lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        lines = lines.join(region("s"), F.col("s_nationkey") == F.col("sn")).join(region("c"), F.col("c_nationkey") == F.col("cn"))
        if name == "R":
            return TensorRel.from_table(lines, ["sr", "cr", F.col("l_linenumber") % 5], "l_quantity", [*shape("r", "r"), 5])
        if name == "Q":
            return TensorRel.from_table(lines, ["sr", "cr", "s_nationkey", "c_nationkey"], F.lit(1), shape("r", "r", "n", "n"))
        if name == "H":
            return TensorRel.from_table(lines, ["sr", "cr", "l_linenumber", "s_nationkey", "c_nationkey"], F.lit(1), shape("r", "r", "k", "n", "n"))
        mod = [F.col(c).cast("bigint") % m for c, m in (("l_quantity", 4), ("l_partkey", 3), ("l_suppkey", 3), ("o_orderkey", 4), ("o_custkey", 5))]
        return TensorRel.from_table(lines, ["sr", "cr", "l_linenumber", *mod], F.lit(1), [*shape("r", "r", "k"), 4, 3, 3, 4, 5])
    if name in ("G", "T"):
        lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        if name == "G":
            return TensorRel.from_table(lines, ["s_nationkey", "c_nationkey"], "l_quantity", shape("n", "n"))
        return TensorRel.from_table(lines, ["s_nationkey", "l_linenumber", "c_nationkey"], F.lit(1), shape("n", "k", "n"))
    if name == "U":
        types = t("events").select("event_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("event_type")) - 1)
        return TensorRel.from_table(t("events").join(types, "event_type"), ["user_id", "k"], F.lit(1))
    if name == "b":
        return TensorRel.from_table(t("supplier"), ["s_nationkey"], F.lit(1), shape("n"))
    if name == "P":
        return TensorRel.from_table(t("part"), ["p_partkey"], "p_size", shape("p"))
    if name == "A":
        return TensorRel.from_table(t("supplier"), ["s_suppkey"], F.floor("s_acctbal"), shape("s"))
    if name == "W":
        cells = t("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
        return TensorRel.from_table(cells, ["vec_id", "pos"], F.floor(F.col("x").cast("double") * 10000 + 0.5))
    if name == "k":
        return TensorRel(t("region").agg(F.count("*").alias("v")), (), "i64")
    raise KeyError(name)


def base_sql(name: str) -> str:
    if name in VIEWS:
        source, axes = VIEWS[name]
        return f"(SELECT {', '.join(f'd{a} AS d{i}' for i, a in enumerate(axes))}, v FROM ({BASE_SQL[source]}))"
    return f"({BASE_SQL[name]})"


def small(t: TensorRel) -> TensorRel:
    return TensorRel(t.df.withColumn("v", F.col("v") % 10), t.shape, t.dtype)


def operands(spark, sf_dir, names: str, name: str) -> list[TensorRel]:
    found: dict[str, TensorRel] = {}
    for x in names.split(","):
        if x not in found:
            t = base(spark, sf_dir, x)
            found[x] = small(t) if name in SMALL else t
    return [found[x] for x in names.split(",")]


def with_tables(names: list[str], sql: str, name: str = "") -> str:
    """sql over the names, each defined once."""
    of = lambda x: f"(SELECT * EXCLUDE (v), v % 10 AS v FROM {base_sql(x)})" if name in SMALL else base_sql(x)
    return "WITH " + ", ".join(f"x_{x} AS MATERIALIZED {of(x)}" for x in dict.fromkeys(names)) + " " + sql


def expressed(expression: str, new) -> EinsumSpec:
    """The parser's language has no operands of rank 0; here a leading comma stands for one."""
    if expression.startswith(","):
        rest = parse(expression[1:], new)
        return EinsumSpec(((), *rest.ixs), rest.iy)
    return parse(expression, new)


def flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    expression, names, algebra, new = FLAT[name]

    def run(spark, sf_dir):
        return C.einsum(expressed(expression, new) if expression.startswith(",") else expression, *operands(spark, sf_dir, names, name), algebra=algebra, sizes=new).df

    return run


def flat_oracle(name: str) -> str:
    expression, names, algebra, new = FLAT[name]
    return with_tables(names.split(","), flat_sql(expressed(expression, new), [f"x_{x}" for x in names.split(",")], algebra, new=new), name)


# ---- queries of their own


def reshape_G(spark, sf_dir):
    g = base(spark, sf_dir, "G")
    return g.reshape([g.numel // 5, 5]).df if g.numel % 5 == 0 else g.reshape([g.numel, 1]).df


def sum_axis_T(spark, sf_dir):
    return base(spark, sf_dir, "T").sum_axis(1).df


def trace_dense_b(spark, sf_dir):
    return C.unary(base(spark, sf_dir, "b"), "i", "ii").to_dense().df


def zeros_G(spark, sf_dir):
    """A zero for every cell of G, with or without a row."""
    return TensorRel.zeros(spark, base(spark, sf_dir, "G").shape, "i64").df


def greedy_vs_treesa(spark, sf_dir):
    """Cells in which two orders differ: none."""
    ts = operands(spark, sf_dir, "L,SN,NR", "")
    spec = parse("sp,sn,nr->pr").bind([t.shape for t in ts])
    a, b = (C.execute(optimize(spec, m), ts).df for m in ("greedy", "treesa"))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("different"))


def argmax_matmul(spark, sf_dir):
    g = base(spark, sf_dir, "G")
    return C.with_winners([g, g], ["ij", "jk"], "ik", "maxplus")


def argmin_matmul(spark, sf_dir):
    g = base(spark, sf_dir, "G")
    return C.with_winners([g, g], ["ij", "jk"], "ik", "minplus")


def argmax_rows(spark, sf_dir):
    return C.with_winners([base(spark, sf_dir, "G")], ["ij"], "i", "maxplus")


def argmax_tensors(spark, sf_dir):
    """Values and winners as tensors of their own, joined."""
    g = base(spark, sf_dir, "G")
    v, k = C.contract_binary_with_argmax(g, g, "ij", "jk", "ik", "maxplus")
    return v.df.join(k.df.withColumnRenamed("v", "k"), ["d0", "d1"])


ARGMAX_SQL = """SELECT d0, d1, v, k FROM (SELECT a.d0 AS d0, b.d1 AS d1, a.v + b.v AS v, a.d1 AS k, ROW_NUMBER() OVER (PARTITION BY a.d0, b.d1 ORDER BY a.v + b.v {order}, a.d1) AS place FROM x_G a JOIN x_G b ON a.d1 = b.d0) WHERE place = 1"""


def gradient(expression: str, names: str, seed: str | None, which: int, algebra: str = "standard", scaled: bool = False):
    """Gradient with respect to one operand, of the seed tensor or ones."""

    def run(spark, sf_dir):
        ts = operands(spark, sf_dir, names, "")
        out, grad = einsum_with_grad(expression, *ts, algebra=algebra, scaled=scaled)
        dy = base(spark, sf_dir, seed) if seed else TensorRel.scalar(spark, 1, "i64").grow([], out.shape)
        return grad.backward(dy, ts)[which].df

    return run


def gradient_scalar(expression: str, names: str, which: int):
    def run(spark, sf_dir):
        ts = operands(spark, sf_dir, names, "")
        return cost_and_gradient(expression, ts)[1][which].df

    return run


#: Winners of C = G ⊗ G with the seed's value, for tropical gradients.
ROUTED_SQL = "SELECT w.d0 AS i, w.k AS j, w.d1 AS k, g.v AS g FROM (" + ARGMAX_SQL + ") w JOIN x_G g ON g.d0 = w.d0 AND g.d1 = w.d1"


def complex_of(t: TensorRel) -> TensorRel:
    """v + (v mod 7) i, in whole numbers that doubles hold exactly."""
    v = F.struct(F.col("v").cast("double").alias("re"), (F.col("v") % 7).cast("double").alias("im"))
    return TensorRel(t.df.withColumn("v", v), t.shape, "c64")


def parts(t: TensorRel) -> DataFrame:
    return t.df.select(*t.dims, F.col("v.re").cast("bigint").alias("re"), F.col("v.im").cast("bigint").alias("im"))


COMPLEX = "x_Z AS (SELECT d0, d1, v AS re, v % 7 AS im FROM x_G)"


def complex_matmul(spark, sf_dir):
    z = complex_of(base(spark, sf_dir, "G"))
    return parts(C.einsum("ij,jk->ik", z, z))


def complex_trace(spark, sf_dir):
    return parts(C.einsum("ii->", complex_of(base(spark, sf_dir, "G"))))


def complex_grad(spark, sf_dir):
    """No conjugation: the gradient of the first factor is the seed times the second."""
    z = complex_of(base(spark, sf_dir, "G"))
    _, grad = einsum_with_grad("ij,jk->ik", z, z)
    return parts(grad.backward(z, [z, z])[0])


def float32_matvec(spark, sf_dir):
    """On values modulo 16, whose sums floats of 32 bits hold exactly."""
    cast = lambda t: TensorRel(t.df.withColumn("v", (F.col("v") % 16).cast("float")), t.shape, "f32")
    g, b = (cast(base(spark, sf_dir, x)) for x in ("G", "b"))
    return C.einsum("ij,j->i", g, b).df.select("d0", F.col("v").cast("bigint").alias("v"))


def topology(spark, sf_dir):
    """Cost of the orders found for a ladder of G: logarithms of products and of the largest result, and the tree's operands."""
    n = base(spark, sf_dir, "G").shape[0]
    spec = parse("ab,cd,ac,bd,be,df,ef,eg,fh,gh->").with_sizes({c: n for c in "abcdefgh"})
    rows = []
    for m in ("left_deep", "greedy", "treesa"):
        found = optimize(spec, m)
        c = complexity(found)
        rows.append((m, round(c.tc, 6), round(c.sc, 6), found.is_optimized and not spec.is_optimized, len(list(found.contraction_tree.leaves()))))
    return spark.createDataFrame(rows, "method string, tc double, sc double, ordered boolean, operands int")


#: From left to right two contractions have four labels, four have three and three have two; the
#: least cost over all orders, which a test finds by dynamic programming, is six of three and three of two.
TOPOLOGY_SQL = """WITH g AS (SELECT CAST(MAX(n_nationkey) + 1 AS DOUBLE) AS n FROM nation)
SELECT 'left_deep' AS method, round(log2(2 * n^4 + 4 * n^3 + 3 * n^2), 6) AS tc, round(4 * log2(n), 6) AS sc, true AS ordered, 10 AS operands FROM g
UNION ALL SELECT m, round(log2(6 * n^3 + 3 * n^2), 6), round(2 * log2(n), 6), true, 10 FROM g, (VALUES ('greedy'), ('treesa')) AS x(m)"""


def share(spark, sf_dir, columns, of: str = "lineitem") -> TensorRel:
    """Twice each cell's share of the rows of a table, by the parity of columns: a tensor of a few numbers near one."""
    lines = table(spark, sf_dir, of)
    n = lines.agg(F.count("*")).collect()[0][0]
    t = TensorRel.from_table(lines, [F.col(c).cast("bigint") % 2 for c in columns], F.lit(1), [2] * len(columns))
    return TensorRel(t.df.withColumn("v", 2.0 * F.col("v").cast("double") / F.lit(float(max(1, n)))), t.shape, "f64")


#: The networks' tensors, 2 x 2 from lineitem.
EDGES = (("l_linenumber", "l_quantity"), ("l_partkey", "l_suppkey"), ("l_orderkey", "l_linenumber"))
EDGES_SQL = ", ".join(f"e{i}(d0, d1, v) AS MATERIALIZED (SELECT CAST({a} AS BIGINT) % 2, CAST({b} AS BIGINT) % 2, 2.0::DOUBLE * CAST(COUNT(*) AS DOUBLE) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM lineitem) FROM lineitem GROUP BY 1, 2)" for i, (a, b) in enumerate(EDGES))


def edges(spark, sf_dir, spec) -> list[TensorRel]:
    ts = [share(spark, sf_dir, x) for x in EDGES]
    return [ts[i % 3] for i in range(len(spec.ixs))]


def network(spec: EinsumSpec, **options):
    """A network of 2 x 2 tensors from lineitem in turn on its edges, so that the result depends on the wiring."""

    def run(spark, sf_dir):
        return C.einsum(spec, *edges(spark, sf_dir, spec), **options).df.select(F.round(F.log("v"), 6).alias("log_v"))

    return run


def network_sql(spec: EinsumSpec) -> str:
    """The same network along a tree, one table expression for each contraction."""
    found = tree_sql(optimize(spec, "greedy") if spec.tree is None else spec, [f"e{i % 3}" for i in range(len(spec.ixs))], kind="DOUBLE")
    return f"WITH {EDGES_SQL}, " + found.replace(" SELECT CAST(t0.v AS DOUBLE) AS v", " SELECT round(ln(t0.v), 6) AS log_v")


def network_sliced(spark, sf_dir):
    """The chord network of 151 vertices in slices of at most 2^12 cells, of an order whose largest result has 2^17."""
    return sliced.execute(CHORDS, edges(spark, sf_dir, CHORDS), cells=1 << 12).df.select(F.round(F.log("v"), 6).alias("log_v"))


#: 223 tensors; a seeded annealed order.
CHORDS = optimize(chord_network(151), "treesa", ntrials=2)

#: Six nations of one region each, with the flow between all pairs: six labels of nations and one of regions.
CLIQUE = [*(f"{a}r" for a in "abcdef"), *(f"{a}{b}" for i, a in enumerate("abcdef") for b in "abcdef"[i + 1 :])]


def sliced_clique(spark, sf_dir):
    """Flows among all sixes of nations of one region, multiplied and added up by region: the tree's largest result has 25^5 x 5 cells, beyond what one task takes."""
    g, nr = base(spark, sf_dir, "G"), base(spark, sf_dir, "NR")
    top_ = g.df.agg(F.max("v")).collect()[0][0] or 1
    g = TensorRel(g.df.withColumn("v", F.col("v").cast("double") / F.lit(float(top_))), g.shape, "f64")
    nr = TensorRel(nr.df.withColumn("v", F.col("v").cast("double")), nr.shape, "f64")
    spec = EinsumSpec([tuple(x) for x in CLIQUE], ("r",))
    return C.einsum(spec, *[nr] * 6, *[g] * 15, strategy="sliced").df.select("d0", F.round(F.log("v"), 6).alias("log_v"))


def sliced_clique_sql() -> str:
    pairs = [x for x in CLIQUE if "r" not in x]
    sources = ", ".join([f"x_NR {a}" for a in "abcdef"] + [f"y g{x}" for x in pairs])
    where = " AND ".join([f"a.d1 = {a}.d1" for a in "bcdef"] + [f"g{x}.d0 = {x[0]}.d0 AND g{x}.d1 = {x[1]}.d0" for x in pairs])
    v = " * ".join(f"g{x}.v" for x in pairs)
    return with_tables(["G", "NR"], "").rstrip() + f", y AS MATERIALIZED (SELECT d0, d1, CAST(v AS DOUBLE) / (SELECT CAST(MAX(v) AS DOUBLE) FROM x_G) AS v FROM x_G) SELECT CAST(a.d1 AS BIGINT) AS d0, round(ln(SUM({v})), 6) AS log_v FROM {sources} WHERE {where} GROUP BY 1"


def counts_of(spark, sf_dir) -> TensorRel:
    """Lines by parity of line number and quantity, modulo 5 and from 1: small whole numbers."""
    t = TensorRel.from_table(table(spark, sf_dir, "lineitem"), [F.col(c).cast("bigint") % 2 for c in EDGES[0]], F.lit(1), [2, 2])
    return TensorRel(t.df.withColumn("v", F.col("v") % 5 + 1), [2, 2], "i64")


def network_relational(spark, sf_dir):
    spec = regular_network(10)
    return C.einsum(spec, *[counts_of(spark, sf_dir)] * len(spec.ixs), strategy="relational").df


def network_relational_sql() -> str:
    spec = regular_network(10)
    a, b = EDGES[0]
    cells = f"SELECT CAST({a} AS BIGINT) % 2 AS d0, CAST({b} AS BIGINT) % 2 AS d1, COUNT(*) % 5 + 1 AS v FROM lineitem GROUP BY 1, 2"
    return f"WITH e AS MATERIALIZED ({cells}) " + flat_sql(spec, ["e"] * len(spec.ixs))


def network_document(spark, sf_dir):
    """A network document of regions and their nations, written and read: an edge for each nation, with a tree."""
    pairs = sorted((r["n_regionkey"], r["n_nationkey"]) for r in table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect())
    spec = optimize(EinsumSpec([(f"r{r}", f"n{n}") for r, n in pairs], (), {c: 2 for r, n in pairs for c in (f"r{r}", f"n{n}")}))
    with tempfile.TemporaryDirectory() as folder:  # a small document, on the driver alone
        json_io.write_json(json_io.network_document(spec, 2), f"{folder}/network.json")
        spec = json_io.read_network(f"{folder}/network.json")
    return C.einsum(spec, *[share(spark, sf_dir, EDGES[1])] * len(spec.ixs)).df.select(F.round(F.log("v"), 6).alias("log_v"))


#: Each region's value to the power of its nations, added up over the region's two values, for all regions.
NETWORK_DOCUMENT_SQL = f"""WITH {EDGES_SQL}, s AS (SELECT d0, SUM(v) AS v FROM e1 GROUP BY 1), n AS (SELECT n_regionkey AS r, COUNT(*) AS c FROM nation GROUP BY 1)
SELECT round(SUM(l), 6) AS log_v FROM (SELECT r, ln(SUM(pow(v, c))) AS l FROM n, s GROUP BY r)"""


def gram_blocks(spark, sf_dir):
    """W'W in blocks of 2^10 cells."""
    w = base(spark, sf_dir, "W")
    return blocked.contract_binary(w, w, "ij", "ik", "jk", cells=1 << 10).df


def matmul_blocks(spark, sf_dir):
    """L L' in blocks of 2^12 cells."""
    x = base(spark, sf_dir, "L")
    return blocked.contract_binary(x, x, "ij", "kj", "ik", cells=1 << 12).df


def maxplus_blocks(spark, sf_dir):
    x = base(spark, sf_dir, "L")
    return blocked.contract_binary(x, x, "ij", "kj", "ik", "maxplus", cells=1 << 12).df


def blocked_sql(algebra: str, having: str = "") -> str:
    return with_tables(["L"], flat_sql(parse("ij,kj->ik"), ["x_L"] * 2, algebra) + having)


def skewed(spark, sf_dir, side: str) -> TensorRel:
    """Lines by customer or supplier and a label of which one value has half of all rows: the part, or 0 for even ones."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.when(F.col("l_partkey") % 2 == 0, 0).otherwise(F.col("l_partkey"))
    n = top(table(spark, sf_dir, "customer"), "c_custkey") if side == "o_custkey" else top(table(spark, sf_dir, "supplier"), "s_suppkey")
    return TensorRel.from_table(lines, [side, k], F.lit(1), [n, top(table(spark, sf_dir, "part"), "p_partkey")])


def skewed_matmul(spark, sf_dir):
    """Customers by suppliers over the skewed label, whose frequent value is dealt as a grid."""
    return skew.contract_binary(skewed(spark, sf_dir, "o_custkey"), skewed(spark, sf_dir, "l_suppkey"), "ck", "sk", "cs", force=True).df


SKEWED_SQL = """WITH l AS (SELECT o_custkey c, l_suppkey s, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE l_partkey END AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT c, k, COUNT(*) AS v FROM l GROUP BY 1, 2), b AS (SELECT s, k, COUNT(*) AS v FROM l GROUP BY 1, 2)
SELECT CAST(c AS BIGINT) AS d0, CAST(s AS BIGINT) AS d1, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM a JOIN b ON a.k = b.k GROUP BY 1, 2"""


def triangle_tensors(spark, sf_dir) -> list[TensorRel]:
    """Quantity by supplier and part, lines by part and customer, lines by customer and supplier: sparse, and a cycle."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = {"l_suppkey": top(table(spark, sf_dir, "supplier"), "s_suppkey"), "l_partkey": top(table(spark, sf_dir, "part"), "p_partkey"), "o_custkey": top(table(spark, sf_dir, "customer"), "c_custkey")}
    of = lambda a, b: TensorRel.from_table(lines, [a, b], F.lit(1), [n[a], n[b]])
    return [base(spark, sf_dir, "L"), of("l_partkey", "o_custkey"), of("o_custkey", "l_suppkey")]


def triangles(spark, sf_dir):
    """Suppliers by their triangles with parts and customers, in one round."""
    return hypercube.execute("sp,pc,cs->s", triangle_tensors(spark, sf_dir)).df


def triangles_maxplus(spark, sf_dir):
    return hypercube.execute("sp,pc,cs->s", triangle_tensors(spark, sf_dir), "maxplus").df


def triangles_sql(form: str) -> str:
    return with_tables(["L"], "").rstrip() + f""", l AS (SELECT o_custkey c, l_suppkey s, l_partkey p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
y AS MATERIALIZED (SELECT p, c, COUNT(*) AS v FROM l GROUP BY 1, 2), z AS MATERIALIZED (SELECT c, s, COUNT(*) AS v FROM l GROUP BY 1, 2)
SELECT CAST(x.d0 AS BIGINT) AS d0, CAST({form} AS BIGINT) AS v FROM x_L x JOIN y ON x.d1 = y.p JOIN z ON y.c = z.c AND z.s = x.d0 GROUP BY 1"""


#: Labels of the rank 20 contractions: nine in common, eleven more of each side.
RANK20 = (tuple(range(20)), (*range(9), *range(20, 31)), tuple(range(9, 31)))


def rank20(spark, sf_dir) -> TensorRel:
    """Customers by twenty bits: eleven of the key, five of the nation, four of the balance."""
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1).cast("bigint"))
    c = [F.col("c_custkey").cast("bigint"), F.col("c_nationkey").cast("bigint"), F.floor(F.abs("c_acctbal")).cast("bigint")]
    bits = [bit(c[0], i) for i in range(11)] + [bit(c[1], i) for i in range(5)] + [bit(c[2], i) for i in range(4)]
    return TensorRel.from_table(table(spark, sf_dir, "customer"), bits, F.lit(1), [2] * 20)


def rank20_pair(spark, sf_dir):
    """The contraction of nine of twenty labels, added up to the last ten."""
    x = rank20(spark, sf_dir)
    return C.unary(C.contract_binary(x, x, *RANK20), RANK20[2], RANK20[2][12:]).df


def rank20_blocks(spark, sf_dir):
    x = rank20(spark, sf_dir)
    return C.unary(blocked.contract_binary(x, x, *RANK20, cells=1 << 14), RANK20[2], RANK20[2][12:]).df


def rank20_sql() -> str:
    bits = [f"(CAST(c_custkey AS BIGINT) >> {i}) & 1" for i in range(11)] + [f"(CAST(c_nationkey AS BIGINT) >> {i}) & 1" for i in range(5)] + [f"(CAST(floor(abs(c_acctbal)) AS BIGINT) >> {i}) & 1" for i in range(4)]
    x = "SELECT " + ", ".join(f"{b} AS d{i}" for i, b in enumerate(bits)) + ", COUNT(*) AS v FROM customer GROUP BY ALL"
    return f"WITH x AS MATERIALIZED ({x}) " + flat_sql(EinsumSpec(RANK20[:2], RANK20[2][12:]), ["x", "x"])


#: A ring with opposite chords, of 75 tensors.
RING = optimize(regular_network(50))


def grad_network(spark, sf_dir):
    """All gradients of a network of 75 tensors from lineitem: each operand's with the operand itself gives the result."""
    ts = edges(spark, sf_dir, RING)
    _, grads = cost_and_gradient(RING, ts)
    out = None
    for i, (t, g) in enumerate(zip(ts, grads, strict=True)):
        row = g.df.withColumnRenamed("v", "g").select(F.lit(i).cast("long").alias("operand"), F.lit(i % 3).alias("kind"), "d0", "d1", "g")
        out = row if out is None else out.unionAll(row)
    cells = None
    for k in range(3):
        x = ts[k].df.select(F.lit(k).alias("kind"), "d0", "d1", "v")
        cells = x if cells is None else cells.unionAll(x)
    return out.join(F.broadcast(cells), ["kind", "d0", "d1"]).groupBy("operand").agg(F.round(F.log(F.sum(F.col("g") * F.col("v"))), 6).alias("log_v"))


def grad_network_sql() -> str:
    found = network_sql(RING)
    at = found.rindex(" SELECT ")
    return found[:at] + ", z AS (" + found[at:] + ") SELECT CAST(x AS BIGINT) AS operand, log_v FROM range(75) r(x), z"


def grad_chain(spark, sf_dir):
    """Gradients of all twelve operands of b G' G' ... G' b, G' being G over its total, by joins and staged tables."""
    g, b = base(spark, sf_dir, "G"), base(spark, sf_dir, "b")
    of = lambda t: TensorRel(t.df.withColumn("v", F.col("v").cast("double") / F.lit(float(t.sum().item() or 1))), t.shape, "f64")
    g, b = of(g), of(b)
    spec = EinsumSpec(((0,), *((i, i + 1) for i in range(10)), (10,)), ()).with_tree(left_deep(12))
    ts = [b, *[g] * 10, b]
    _, grads = cost_and_gradient(spec, ts, strategy="relational")
    out = None
    for i, (t, x) in enumerate(zip(ts, grads, strict=True)):
        both = x.df.withColumnRenamed("v", "g").join(t.df, t.dims)
        row = both.agg(F.round(F.log(F.sum(F.col("g") * F.col("v"))), 6).alias("log_v")).select(F.lit(i).cast("long").alias("operand"), "log_v")
        out = row if out is None else out.unionAll(row)
    return out


GRAD_CHAIN_SQL = (
    ", g AS MATERIALIZED (SELECT d0, d1, CAST(v AS DOUBLE) / (SELECT CAST(SUM(v) AS DOUBLE) FROM x_G) AS v FROM x_G), c0 AS MATERIALIZED (SELECT d0, CAST(v AS DOUBLE) / (SELECT CAST(SUM(v) AS DOUBLE) FROM x_b) AS v FROM x_b), "
    + ", ".join(f"c{i + 1} AS MATERIALIZED (SELECT g.d1 AS d0, SUM(c{i}.v * g.v) AS v FROM c{i} JOIN g ON c{i}.d0 = g.d0 GROUP BY 1)" for i in range(10))
    + " SELECT CAST(x AS BIGINT) AS operand, (SELECT round(ln(SUM(a.v * b.v)), 6) FROM c10 a JOIN c0 b ON a.d0 = b.d0) AS log_v FROM range(12) r(x)"
)


def rows_order(spark, sf_dir):
    """Customers by the suppliers of the parts that they ordered, in the order of the fewest rows: dense sizes have lines meet the suppliers of their parts first, rows the customer of their order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = {c: top(table(spark, sf_dir, t), c) for t, c in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))}
    oc = TensorRel.from_table(orders, ["o_orderkey", "o_custkey"], F.lit(1), [n["o_orderkey"], n["c_custkey"]])
    op = TensorRel.from_table(lines, ["l_orderkey", "l_partkey"], F.lit(1), [n["o_orderkey"], n["p_partkey"]])
    ps = TensorRel.from_table(lines, ["l_partkey", "l_suppkey"], F.lit(1), [n["p_partkey"], n["s_suppkey"]])
    return C.execute(by_rows(parse("oc,op,ps->cs"), [oc, op, ps]), [oc, op, ps]).df


ROWS_ORDER_SQL = """WITH op AS (SELECT l_orderkey o, l_partkey p, COUNT(*) AS v FROM lineitem GROUP BY 1, 2), ps AS (SELECT l_partkey p, l_suppkey s, COUNT(*) AS v FROM lineitem GROUP BY 1, 2),
cp AS MATERIALIZED (SELECT o_custkey c, p, SUM(v) AS v FROM op JOIN orders ON o_orderkey = o GROUP BY 1, 2)
SELECT CAST(c AS BIGINT) AS d0, CAST(s AS BIGINT) AS d1, CAST(SUM(cp.v * ps.v) AS BIGINT) AS v FROM cp JOIN ps ON cp.p = ps.p GROUP BY 1, 2"""


def kbest_matmul(spark, sf_dir):
    """The three greatest sums of two cells of G for each pair of nations, with the nation between."""
    g = base(spark, sf_dir, "G")
    return k_best("ij,jk->ik", g, g, k=3)[0]


def kbest_paths(spark, sf_dir):
    """The four least sums of three cells of G for each pair of nations."""
    g = base(spark, sf_dir, "G")
    return k_best("ij,jk,kl->il", g, g, g, k=4, algebra="minplus")[0].select("d0", "d1", "rank", "v")


def kbest_sql(names: str, v: str, join: str, ends: str, order: str, k: int, witness: str = "") -> str:
    """Members ranked in each cell; ties by the witness, which doesn't show where it isn't selected."""
    w = f", CAST({witness} AS BIGINT) AS w0" if witness else ""
    rank = f"CAST(ROW_NUMBER() OVER (PARTITION BY a.d0, {ends} ORDER BY {v} {order}{', ' + witness if witness else ''}) AS INTEGER) AS rank"
    return with_tables([names], f"SELECT * FROM (SELECT CAST(a.d0 AS BIGINT) AS d0, CAST({ends} AS BIGINT) AS d1, {rank}, CAST({v} AS BIGINT) AS v{w} FROM {join}) WHERE rank <= {k}")


def factored_outer(spark, sf_dir):
    """Four tables of nations by region as an outer product of eight labels that is never made, contracted with flows between their nations."""
    nr, g = base(spark, sf_dir, "NR"), small(base(spark, sf_dir, "G"))
    outer = factored("ij,kl,mn,op->ijklmnop", nr, nr, nr, nr)
    return factored_einsum("ijklmnop,ik,km,mo->jlnp", outer, g, g, g).df


FACTORED_SQL = "SELECT CAST(a.d1 AS BIGINT) AS d0, CAST(b.d1 AS BIGINT) AS d1, CAST(c.d1 AS BIGINT) AS d2, CAST(d.d1 AS BIGINT) AS d3, CAST(SUM((x.v % 10) * (y.v % 10) * (z.v % 10)) AS BIGINT) AS v FROM x_NR a JOIN x_G x ON x.d0 = a.d0 JOIN x_NR b ON b.d0 = x.d1 JOIN x_G y ON y.d0 = b.d0 JOIN x_NR c ON c.d0 = y.d1 JOIN x_G z ON z.d0 = c.d0 JOIN x_NR d ON d.d0 = z.d1 GROUP BY ALL"


def t_method(spark, sf_dir):
    return base(spark, sf_dir, "G").t().contiguous().df


def tensor_metadata(spark, sf_dir):
    """Rank, size and stride of each axis of some tensors, and their cells."""
    rows = []
    for name in ("G", "L", "SN"):
        t = base(spark, sf_dir, name)
        rows += [(name, i, t.ndim, n, s, t.numel, t.is_contiguous) for i, (n, s) in enumerate(zip(t.shape, t.strides, strict=True))]
    return spark.createDataFrame(rows, "tensor string, axis int, ndim int, size long, stride long, numel long, contiguous boolean")


METADATA_SQL = """WITH n AS (SELECT CAST(MAX(n_nationkey) + 1 AS BIGINT) AS n FROM nation), s AS (SELECT CAST(MAX(s_suppkey) + 1 AS BIGINT) AS s FROM supplier), p AS (SELECT CAST(MAX(p_partkey) + 1 AS BIGINT) AS p FROM part),
x AS (SELECT 'G' AS tensor, n AS a, n AS b FROM n UNION ALL SELECT 'L', s, p FROM s, p UNION ALL SELECT 'SN', s, n FROM s, n)
SELECT tensor, axis, 2 AS ndim, CASE axis WHEN 0 THEN a ELSE b END AS size, CASE axis WHEN 0 THEN 1 ELSE a END AS stride, a * b AS numel, true AS contiguous FROM x, (VALUES (0), (1)) AS y(axis)"""


def zero_cells(spark, sf_dir):
    """Cells of T that are the zero of ordinary and of max-plus algebra, and cells above 3, by line number."""
    t = base(spark, sf_dir, "T")
    a, m, kind = algebra("standard"), algebra("maxplus"), t.dtype
    d, e = t.to_dense().df, t.to_dense("maxplus").df
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    d = d.groupBy("d1").agg(count(is_zero(F.col("v"), a, kind), "zeros"), count(m.better(F.col("v"), F.lit(3)), "better"))
    return d.join(e.groupBy("d1").agg(count(is_zero(F.col("v"), m, kind), "tropical_zeros")), "d1")


ZERO_CELLS_SQL = """SELECT CAST(k.x AS BIGINT) AS d1, CAST(n * n - COUNT(t.v) AS BIGINT) AS zeros, CAST(n * n - COUNT(t.v) AS BIGINT) AS tropical_zeros, CAST(COUNT(CASE WHEN t.v > 3 THEN 1 END) AS BIGINT) AS better
FROM (SELECT unnest(range((SELECT MAX(l_linenumber) + 1 FROM lineitem))) AS x) k CROSS JOIN (SELECT MAX(n_nationkey) + 1 AS n FROM nation) LEFT JOIN x_T t ON t.d1 = k.x GROUP BY k.x, n"""


def gradient_hooks(spark, sf_dir):
    """Gradients of x + y, x * y and max(x, y) for each cell of G and its mirror image, the gradient of the result being the cell's row."""
    g = base(spark, sf_dir, "G")
    d = g.df.join(g.t().df.withColumnRenamed("v", "w"), ["d0", "d1"])
    x, y, dy, t = F.col("v"), F.col("w"), F.col("d0"), g.dtype
    pair = lambda name, f, a: [c.cast("bigint").alias(f"{name}_{s}") for s, c in zip("xy", f(algebra(a), x, y, dy, t), strict=True)]
    return d.select("d0", "d1", *pair("plus", plus_gradient, "standard"), *pair("times", times_gradient, "standard"), *pair("max", plus_gradient, "maxplus"), *pair("added", times_gradient, "maxplus"))


HOOKS_SQL = """SELECT CAST(g.d0 AS BIGINT) AS d0, CAST(g.d1 AS BIGINT) AS d1, CAST(g.d0 AS BIGINT) AS plus_x, CAST(g.d0 AS BIGINT) AS plus_y, CAST(g.d0 * h.v AS BIGINT) AS times_x, CAST(g.d0 * g.v AS BIGINT) AS times_y,
CAST(CASE WHEN h.v > g.v THEN 0 ELSE g.d0 END AS BIGINT) AS max_x, CAST(CASE WHEN h.v > g.v THEN g.d0 ELSE 0 END AS BIGINT) AS max_y, CAST(g.d0 AS BIGINT) AS added_x, CAST(g.d0 AS BIGINT) AS added_y FROM x_G g JOIN x_G h ON g.d0 = h.d1 AND g.d1 = h.d0"""


def gram_dense(spark, sf_dir):
    """W'W over all embeddings: an array for as many rows as the dense path holds, and the sum of their products."""
    w = base(spark, sf_dir, "W")
    m = w.shape[1]
    n = max(1, dense.CELLS // (2 * m))
    spec = optimize(parse("ij,ik->jk").with_sizes({"i": n, "j": m, "k": m}))
    ship_code(spark)

    def run(block):
        x = np.zeros((n, m))
        np.add.at(x, (block.column("i").to_numpy(), block.column("j").to_numpy()), block.column("v").to_numpy())
        found = dense.evaluate(spec, [x, x], "standard", 0.0)
        d0, d1 = np.indices(found.shape).reshape(2, -1)
        return pa.table({"d0": d0, "d1": d1, "v": found.reshape(-1).astype(np.int64)})

    cells = w.df.where("d0 IS NOT NULL").select(F.floor(F.col("d0") / n).alias("block"), (F.col("d0") % n).alias("i"), F.col("d1").alias("j"), F.col("v").cast("double").alias("v"))
    parts = cells.groupBy("block").applyInArrow(run, "d0 bigint, d1 bigint, v bigint")
    return parts.groupBy("d0", "d1").agg(F.sum("v").alias("v"))


def table_maxplus(spark, sf_dir):
    """A tensor from a table under another algebra: the largest quantity by supplier and part."""
    return TensorRel.from_table(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], "l_quantity", algebra_="maxplus").df


def custom_algebra(spark, sf_dir):
    """Bitwise or of bitwise ands, an algebra that isn't built in."""
    a = custom("bits", lambda x, y: x.bitwiseAND(y), lambda v: F.bit_or(v), 0, -1)
    g = base(spark, sf_dir, "G")
    return C.einsum("ij,jk->ik", g, g, algebra=a).df


def storage_G(spark, sf_dir):
    """A tensor to its flat storage and back."""
    g = base(spark, sf_dir, "G").to_dense()
    return TensorRel.from_storage(g.df.select(g.linear().alias("lin"), "v"), g.shape, "i64").df


def diagonal_method(spark, sf_dir):
    return base(spark, sf_dir, "G").diagonal().df


def left_to_right(spark, sf_dir):
    """A spec without a tree is contracted from left to right."""
    return C.execute(parse("ij,jk,kl->il"), operands(spark, sf_dir, "G,G,NR", "")).df


def builder_matmul(spark, sf_dir):
    g = base(spark, sf_dir, "G")
    n = g.shape[0]
    spec = EinBuilder().input("ij").input("kj").output("ik").sizes([("i", n), ("j", n), ("k", n)]).build()
    return C.einsum(spec, g, g).df


def argmax_tree(spark, sf_dir):
    """The result of a tree of two contractions with the winners of each: j for (i, k), then k for (i, l)."""
    g = base(spark, sf_dir, "G")
    out, (first, last) = C.execute_with_argmax("(ij,jk),kl->il", g, g, g, algebra="maxplus")
    last = last.df.select("d0", "d1", F.col("v").alias("k"))
    first = first.df.select("d0", F.col("d1").alias("k"), F.col("v").alias("j"))
    return out.df.join(last, ["d0", "d1"]).join(first, ["d0", "k"]).select("d0", "d1", "v", "j", "k")


ARGMAX_TREE_SQL = """, f AS (SELECT a.d0 AS d0, b.d1 AS d1, a.v + b.v AS v, a.d1 AS j, ROW_NUMBER() OVER (PARTITION BY a.d0, b.d1 ORDER BY a.v + b.v DESC, a.d1) AS place FROM x_G a JOIN x_G b ON a.d1 = b.d0),
s AS (SELECT f.d0, g.d1, f.v + g.v AS v, f.j, f.d1 AS k, ROW_NUMBER() OVER (PARTITION BY f.d0, g.d1 ORDER BY f.v + g.v DESC, f.d1) AS place FROM f JOIN x_G g ON f.d1 = g.d0 WHERE f.place = 1)
SELECT CAST(d0 AS BIGINT) AS d0, CAST(d1 AS BIGINT) AS d1, v, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k FROM s WHERE place = 1"""


def binary_backward(spark, sf_dir):
    """Both gradients of one batched contraction, side 0 for T and side 1 for G."""
    x, g, dy = base(spark, sf_dir, "T"), base(spark, sf_dir, "G"), base(spark, sf_dir, "T").sum_axis(2)
    ga, gb = contract_binary_backward(x, g, "bij", "bj", "bi", dy)
    side = lambda t, i: t.df.select(F.lit(i).alias("side"), "d0", "d1", *([F.col("d2")] if t.ndim == 3 else [F.lit(-1).cast("bigint").alias("d2")]), "v")
    return side(ga, 0).unionAll(side(gb, 1)).where("v <> 0")


BACKWARD_SQL = """, y AS (SELECT d0, d1, CAST(SUM(v) AS BIGINT) AS v FROM x_T GROUP BY 1, 2)
SELECT 0 AS side, CAST(y.d0 AS BIGINT) AS d0, CAST(y.d1 AS BIGINT) AS d1, CAST(g.d1 AS BIGINT) AS d2, CAST(y.v * g.v AS BIGINT) AS v FROM y JOIN x_G g ON y.d0 = g.d0 WHERE y.v * g.v <> 0
UNION ALL SELECT 1, CAST(t.d0 AS BIGINT), CAST(t.d2 AS BIGINT), CAST(-1 AS BIGINT), CAST(SUM(t.v * y.v) AS BIGINT) FROM x_T t JOIN y ON t.d0 = y.d0 AND t.d1 = y.d1 GROUP BY 2, 3 HAVING SUM(t.v * y.v) <> 0"""


def documents_of(spark, sf_dir, order: str) -> str:
    """A tensor document of the customers by nation, twice, written by tasks to the shared folder."""
    t = base(spark, sf_dir, "CN")
    t = TensorRel(t.df.withColumn("v", F.col("v").cast("double")), t.shape, "f64")
    path = new_folder(spark, "tensors")
    json_parts.write_tensors(path, [t, t], order)
    return path


def whole_numbers(t: TensorRel) -> DataFrame:
    return t.df.select(*t.dims, F.col("v").cast("bigint").alias("v")).where("v <> 0")


def of_result(spark, path: str, entry=None) -> TensorRel:
    """The tensor of a result document, or of a gradient's entry in one."""
    d = json_parts.Document(spark, path)
    t, order = json_io.checked(d.doc)
    return d.tensor(d.doc if entry is None else entry(d.doc), t, order)


def json_tensors(spark, sf_dir):
    """A tensor document in row-major order, written and read."""
    ts, order = json_io.read_tensors(spark, documents_of(spark, sf_dir, "row_major"))
    return whole_numbers(ts[1])


def command(*args: str) -> None:
    if cli.main([*args]):
        raise RuntimeError("the command failed")


def cli_contract(spark, sf_dir):
    out = new_folder(spark, "result")
    command("contract", documents_of(spark, sf_dir, "row_major"), "--expr", "ij,ik->jk", "--parts", "-o", out)
    return whole_numbers(of_result(spark, out))


def cli_topology(spark, sf_dir):
    """An order found by one command and followed by another."""
    tensors, out = documents_of(spark, sf_dir, "col_major"), new_folder(spark, "result")
    n, r = base(spark, sf_dir, "CN").shape
    with tempfile.TemporaryDirectory() as folder:  # a small document, on the driver alone
        command("optimize", "ni,nj->ij", "--sizes", f"n={n},i={r},j={r}", "--method", "treesa", "-o", f"{folder}/topology.json")
        command("contract", tensors, "-t", f"{folder}/topology.json", "--parts", "-o", out)
    return whole_numbers(of_result(spark, out))


def cli_autodiff(spark, sf_dir):
    """The gradient of a sum of squares, as sum of its two parts."""
    out = new_folder(spark, "gradients")
    command("autodiff", documents_of(spark, sf_dir, "col_major"), "--expr", "nr,nr->", "--parts", "-o", out)
    both = [whole_numbers(of_result(spark, out, lambda d, i=i: d["gradients"][i])) for i in range(2)]
    return both[0].unionAll(both[1]).groupBy("d0", "d1").agg(F.sum("v").alias("v"))


def cli_seed(spark, sf_dir):
    """Gradients of a product with G as that of the result, from a document of its own, as sum of both."""
    g, out, seed = base(spark, sf_dir, "G"), new_folder(spark, "gradients"), new_folder(spark, "seed")
    json_parts.write_result(seed, TensorRel(g.df.withColumn("v", F.col("v").cast("double")), g.shape, "f64"), "row_major")
    command("autodiff", documents_of(spark, sf_dir, "row_major"), "--expr", "cn,cm->nm", "--grad-output", seed, "--parts", "-o", out)
    both = [whole_numbers(of_result(spark, out, lambda d, i=i: d["gradients"][i])) for i in range(2)]
    return both[0].unionAll(both[1]).groupBy("d0", "d1").agg(F.sum("v").alias("v"))


SEED_SQL = """SELECT CAST(d0 AS BIGINT) AS d0, CAST(d1 AS BIGINT) AS d1, CAST(SUM(v) AS BIGINT) AS v FROM (
SELECT c.d0, g.d0 AS d1, g.v FROM x_CN c JOIN x_G g ON g.d1 = c.d1 UNION ALL SELECT c.d0, g.d1, g.v FROM x_CN c JOIN x_G g ON g.d0 = c.d1) GROUP BY 1, 2"""


def cli_errors(spark, sf_dir):
    """Exit codes of commands over the customers' document: one that works and some that can't."""
    tensors, out = documents_of(spark, sf_dir, "col_major"), new_folder(spark, "result")
    cases = {
        "contract": ["contract", tensors, "--expr", "ij,ik->jk", "--parts", "-o", out],
        "mismatch": ["contract", tensors, "--expr", "ij,jk->ik"],
        "rank": ["contract", tensors, "--expr", "ijk,ik->jk"],
        "operands": ["contract", tensors, "--expr", "ij->ji"],
        "neither": ["contract", tensors],
        "seed": ["autodiff", tensors, "--expr", "ij,ik->jk"],
        "absent": ["contract", tensors + "-none", "--expr", "ij,ik->jk"],
    }
    with contextlib.redirect_stderr(io.StringIO()):
        rows = [(name, cli.main(args)) for name, args in cases.items()]
    cells = of_result(spark, out).df.where("v <> 0").agg(F.count("*").alias("cells"))
    return spark.createDataFrame(rows, "command string, code int").join(F.broadcast(cells))


def region_seed(spark, sf_dir):
    return C.einsum("ij,ia,jb->ab", *operands(spark, sf_dir, "G,NR,NR", ""))


def grad_chain3(spark, sf_dir):
    ts = operands(spark, sf_dir, "NR,G,NR", "")
    _, grad = einsum_with_grad("ia,ij,jb->ab", *ts)
    return grad.backward(region_seed(spark, sf_dir), ts)[1].df


OWN: dict[str, tuple[Callable, str | None]] = {
    "reshape_G": (reshape_G, with_tables(["G"], "SELECT (d0 + n * d1) % 125 AS d0, (d0 + n * d1) // 125 AS d1, v FROM x_G, (SELECT CAST(MAX(n_nationkey) + 1 AS BIGINT) AS n FROM nation)")),
    "sum_axis_T": (sum_axis_T, with_tables(["T"], "SELECT CAST(d0 AS BIGINT) AS d0, CAST(d2 AS BIGINT) AS d1, CAST(SUM(v) AS BIGINT) AS v FROM x_T GROUP BY 1, 2")),
    "diag_embed_b_dense": (trace_dense_b, with_tables(["b"], "SELECT CAST(i.x AS BIGINT) AS d0, CAST(j.x AS BIGINT) AS d1, CASE WHEN i.x = j.x THEN COALESCE(b.v, 0) ELSE 0 END AS v FROM (SELECT unnest(range((SELECT MAX(n_nationkey) + 1 FROM nation))) AS x) i, (SELECT unnest(range((SELECT MAX(n_nationkey) + 1 FROM nation))) AS x) j LEFT JOIN x_b b ON b.d0 = i.x")),
    "zeros_G": (zeros_G, "SELECT CAST(a.x AS BIGINT) AS d0, CAST(b.x AS BIGINT) AS d1, CAST(0 AS BIGINT) AS v FROM (SELECT unnest(range((SELECT MAX(n_nationkey) + 1 FROM nation))) AS x) a, (SELECT unnest(range((SELECT MAX(n_nationkey) + 1 FROM nation))) AS x) b"),
    "greedy_vs_treesa": (greedy_vs_treesa, "SELECT CAST(0 AS BIGINT) AS different"),
    "argmax_matmul": (argmax_matmul, with_tables(["G"], "SELECT CAST(d0 AS BIGINT) AS d0, CAST(d1 AS BIGINT) AS d1, v, CAST(k AS BIGINT) AS k FROM (" + ARGMAX_SQL.format(order="DESC") + ")")),
    "argmin_matmul": (argmin_matmul, with_tables(["G"], "SELECT CAST(d0 AS BIGINT) AS d0, CAST(d1 AS BIGINT) AS d1, v, CAST(k AS BIGINT) AS k FROM (" + ARGMAX_SQL.format(order="ASC") + ")")),
    "argmax_rows": (argmax_rows, with_tables(["G"], "SELECT CAST(d0 AS BIGINT) AS d0, v, CAST(d0 + n * d1 AS BIGINT) AS k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY d0 ORDER BY v DESC, d1) AS place FROM x_G), (SELECT MAX(n_nationkey) + 1 AS n FROM nation) WHERE place = 1")),
    "grad_matmul_a": (gradient("ij,jk->ik", "G,G", "G", 0), with_tables(["G"], flat_sql(parse("ik,jk->ij"), ["x_G"] * 2))),
    "grad_matmul_b": (gradient("ij,jk->ik", "G,G", "G", 1), with_tables(["G"], flat_sql(parse("ij,ik->jk"), ["x_G"] * 2))),
    "grad_trace": (gradient_scalar("ii->", "G", 0), "SELECT CAST(x AS BIGINT) AS d0, CAST(x AS BIGINT) AS d1, CAST(1 AS BIGINT) AS v FROM (SELECT unnest(range((SELECT MAX(n_nationkey) + 1 FROM nation))) AS x)"),
    "grad_sum": (gradient_scalar("ij->", "G", 0), "SELECT CAST(a.x AS BIGINT) AS d0, CAST(b.x AS BIGINT) AS d1, CAST(1 AS BIGINT) AS v FROM (SELECT unnest(range((SELECT MAX(n_nationkey) + 1 FROM nation))) AS x) a, (SELECT unnest(range((SELECT MAX(n_nationkey) + 1 FROM nation))) AS x) b"),
    "grad_diag": (gradient("ii->i", "G", "b", 0), with_tables(["b"], flat_sql(parse("i->ii"), ["x_b"]))),
    "grad_outer": (gradient("i,j->ij", "b,b", "G", 0), with_tables(["G", "b"], flat_sql(parse("ij,j->i"), ["x_G", "x_b"]))),
    "grad_chain3": (grad_chain3, with_tables(["G", "NR"], "SELECT CAST(a.d0 AS BIGINT) AS d0, CAST(b.d0 AS BIGINT) AS d1, s.v AS v FROM x_NR a, x_NR b, (" + flat_sql(parse("ij,ia,jb->ab"), ["x_G", "x_NR", "x_NR"]) + ") s WHERE s.d0 = a.d1 AND s.d1 = b.d1")),
    "grad_star_scalar": (gradient_scalar("i,i,i->", "b,b,b", 1), with_tables(["b"], flat_sql(parse("i,i->i"), ["x_b"] * 2))),
    "grad_cycle3": (gradient_scalar("ij,jk,ki->", "G,G,G", 0), with_tables(["G"], flat_sql(parse("jk,ki->ij"), ["x_G"] * 2))),
    "grad_maxplus_a": (gradient("ij,jk->ik", "G,G", "G", 0, "maxplus"), with_tables(["G"], "SELECT CAST(i AS BIGINT) AS d0, CAST(j AS BIGINT) AS d1, CAST(SUM(g) AS BIGINT) AS v FROM (" + ROUTED_SQL.format(order="DESC") + ") GROUP BY 1, 2")),
    "grad_maxplus_b": (gradient("ij,jk->ik", "G,G", "G", 1, "maxplus"), with_tables(["G"], "SELECT CAST(j AS BIGINT) AS d0, CAST(k AS BIGINT) AS d1, CAST(SUM(g) AS BIGINT) AS v FROM (" + ROUTED_SQL.format(order="DESC") + ") GROUP BY 1, 2")),
    "grad_minplus": (gradient("ij,jk->ik", "G,G", "G", 0, "minplus"), with_tables(["G"], "SELECT CAST(i AS BIGINT) AS d0, CAST(j AS BIGINT) AS d1, CAST(SUM(g) AS BIGINT) AS v FROM (" + ROUTED_SQL.format(order="ASC") + ") GROUP BY 1, 2")),
    "grad_row_max": (gradient("ij->i", "G", "b", 0, "maxplus"), with_tables(["G", "b"], "SELECT CAST(g.d0 AS BIGINT) AS d0, CAST(g.d1 AS BIGINT) AS d1, b.v AS v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY d0 ORDER BY v DESC, d1) AS place FROM x_G) g JOIN x_b b ON b.d0 = g.d0 WHERE place = 1")),
    "complex_matmul": (complex_matmul, with_tables(["G"], "").rstrip() + f", {COMPLEX} SELECT CAST(a.d0 AS BIGINT) AS d0, CAST(b.d1 AS BIGINT) AS d1, CAST(SUM(a.re * b.re - a.im * b.im) AS BIGINT) AS re, CAST(SUM(a.re * b.im + a.im * b.re) AS BIGINT) AS im FROM x_Z a JOIN x_Z b ON a.d1 = b.d0 GROUP BY 1, 2"),
    "complex_trace": (complex_trace, with_tables(["G"], "").rstrip() + f", {COMPLEX} SELECT CAST(SUM(re) AS BIGINT) AS re, CAST(SUM(im) AS BIGINT) AS im FROM x_Z WHERE d0 = d1"),
    "complex_grad": (complex_grad, with_tables(["G"], "").rstrip() + f", {COMPLEX} SELECT CAST(a.d0 AS BIGINT) AS d0, CAST(b.d0 AS BIGINT) AS d1, CAST(SUM(a.re * b.re - a.im * b.im) AS BIGINT) AS re, CAST(SUM(a.re * b.im + a.im * b.re) AS BIGINT) AS im FROM x_Z a JOIN x_Z b ON a.d1 = b.d1 GROUP BY 1, 2"),
    "float32_matvec": (float32_matvec, with_tables(["G", "b"], "SELECT CAST(g.d0 AS BIGINT) AS d0, CAST(SUM((g.v % 16) * (b.v % 16)) AS BIGINT) AS v FROM x_G g JOIN x_b b ON g.d1 = b.d0 GROUP BY 1")),
    "gram_dense": (gram_dense, with_tables(["W"], flat_sql(parse("ij,ik->jk"), ["x_W"] * 2))),
    "table_maxplus": (table_maxplus, "SELECT l_suppkey AS d0, l_partkey AS d1, CAST(MAX(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2"),
    "custom_algebra": (custom_algebra, with_tables(["G"], "SELECT CAST(a.d0 AS BIGINT) AS d0, CAST(b.d1 AS BIGINT) AS d1, CAST(BIT_OR(a.v & b.v) AS BIGINT) AS v FROM x_G a JOIN x_G b ON a.d1 = b.d0 GROUP BY 1, 2")),
    "storage_G": (storage_G, with_tables(["G"], "SELECT CAST(i.x AS BIGINT) AS d0, CAST(j.x AS BIGINT) AS d1, COALESCE(g.v, 0) AS v FROM (SELECT unnest(range((SELECT MAX(n_nationkey) + 1 FROM nation))) AS x) i CROSS JOIN (SELECT unnest(range((SELECT MAX(n_nationkey) + 1 FROM nation))) AS x) j LEFT JOIN x_G g ON g.d0 = i.x AND g.d1 = j.x")),
    "diagonal_method": (diagonal_method, with_tables(["G"], "SELECT CAST(d0 AS BIGINT) AS d0, v FROM x_G WHERE d0 = d1")),
    "left_to_right": (left_to_right, with_tables(["G", "NR"], flat_sql(parse("ij,jk,kl->il"), ["x_G", "x_G", "x_NR"]))),
    "builder_matmul": (builder_matmul, with_tables(["G"], flat_sql(parse("ij,kj->ik"), ["x_G"] * 2))),
    "argmax_tree": (argmax_tree, with_tables(["G"], "").rstrip() + ARGMAX_TREE_SQL),
    "binary_backward": (binary_backward, with_tables(["T", "G"], "").rstrip() + BACKWARD_SQL),
    "argmax_tensors": (argmax_tensors, with_tables(["G"], "SELECT CAST(d0 AS BIGINT) AS d0, CAST(d1 AS BIGINT) AS d1, v, CAST(k AS BIGINT) AS k FROM (" + ARGMAX_SQL.format(order="DESC") + ")")),
    "json_tensors": (json_tensors, with_tables(["CN"], "SELECT CAST(d0 AS BIGINT) AS d0, CAST(d1 AS BIGINT) AS d1, v FROM x_CN")),
    "cli_contract": (cli_contract, with_tables(["CN"], flat_sql(parse("ij,ik->jk"), ["x_CN"] * 2))),
    "cli_topology": (cli_topology, with_tables(["CN"], flat_sql(parse("ni,nj->ij"), ["x_CN"] * 2))),
    "cli_autodiff": (cli_autodiff, with_tables(["CN"], "SELECT CAST(d0 AS BIGINT) AS d0, CAST(d1 AS BIGINT) AS d1, 2 * v AS v FROM x_CN")),
    "cli_seed": (cli_seed, with_tables(["CN", "G"], SEED_SQL)),
    "cli_errors": (cli_errors, with_tables(["CN"], "SELECT command, code, (SELECT COUNT(DISTINCT d1) FROM x_CN) AS cells FROM (VALUES ('contract', 0), ('mismatch', 1), ('rank', 1), ('operands', 1), ('neither', 1), ('seed', 1), ('absent', 1)) AS x(command, code)")),
    "optimize_topology": (topology, TOPOLOGY_SQL),
    "network_small": (network(regular_network(10)), network_sql(regular_network(10))),
    "network_medium": (network(regular_network(50)), network_sql(regular_network(50))),
    "network_large": (network(regular_network(100)), network_sql(regular_network(100))),
    "network_225": (network(regular_network(150)), network_sql(regular_network(150))),
    "network_chords": (network(CHORDS), network_sql(CHORDS)),
    "network_sliced": (network_sliced, network_sql(CHORDS)),
    "network_relational": (network_relational, network_relational_sql()),
    "network_document": (network_document, NETWORK_DOCUMENT_SQL),
    "sliced_clique": (sliced_clique, sliced_clique_sql()),
    "gram_blocks": (gram_blocks, with_tables(["W"], flat_sql(parse("ij,ik->jk"), ["x_W"] * 2) + " HAVING SUM(t0.v * t1.v) <> 0")),
    "matmul_blocks": (matmul_blocks, blocked_sql("standard", " HAVING SUM(t0.v * t1.v) <> 0")),
    "maxplus_blocks": (maxplus_blocks, blocked_sql("maxplus")),
    "skewed_matmul": (skewed_matmul, SKEWED_SQL),
    "triangles": (triangles, triangles_sql("SUM(x.v * y.v * z.v)")),
    "triangles_maxplus": (triangles_maxplus, triangles_sql("MAX(x.v + y.v + z.v)")),
    "rank20_pair": (rank20_pair, rank20_sql()),
    "rank20_blocks": (rank20_blocks, rank20_sql()),
    "grad_network": (grad_network, grad_network_sql()),
    "grad_chain12": (grad_chain, with_tables(["G", "b"], "").rstrip() + GRAD_CHAIN_SQL),
    "rows_order": (rows_order, ROWS_ORDER_SQL),
    "kbest_matmul": (kbest_matmul, kbest_sql("G", "(a.v + b.v)", "x_G a JOIN x_G b ON a.d1 = b.d0", "b.d1", "DESC", 3, "a.d1")),
    "kbest_paths": (kbest_paths, kbest_sql("G", "(a.v + b.v + c.v)", "x_G a JOIN x_G b ON a.d1 = b.d0 JOIN x_G c ON b.d1 = c.d0", "c.d1", "ASC", 4)),
    "factored_outer": (factored_outer, with_tables(["NR", "G"], FACTORED_SQL)),
    "t_method": (t_method, with_tables(["G"], "SELECT CAST(d1 AS BIGINT) AS d0, CAST(d0 AS BIGINT) AS d1, v FROM x_G")),
    "tensor_metadata": (tensor_metadata, METADATA_SQL),
    "zero_cells": (zero_cells, with_tables(["T"], ZERO_CELLS_SQL)),
    "gradient_hooks": (gradient_hooks, with_tables(["G"], HOOKS_SQL)),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by how much they deliver of the same parts: L L'."""
    return flat("matmul_LLt")(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: flat(n) for n in FLAT} | {n: f for n, (f, _) in OWN.items()}


def oracle_sql() -> dict[str, str]:
    return {n: flat_oracle(n) for n in FLAT} | {n: sql for n, (_, sql) in OWN.items() if sql is not None}
