"""Command line: optimize, contract and autodiff over JSON documents."""

from __future__ import annotations

import argparse
import os
import sys

from .operators.autodiff import einsum_with_grad
from .operators.contract import einsum
from .plans.order import optimize
from .plans.spec import EinsumSpec, parse
from .sources import json_io, json_parts
from .sources.tensor import TensorRel


def session():
    """The active session, or a new one."""
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or (
        SparkSession.builder.master(os.environ.get("TENSORLOOM_MASTER", "local[2]")).appName("tensorloom")
        .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def sizes_of(text: str, spec: EinsumSpec) -> dict[str, int]:
    """ "i=2,j=3" as sizes of the expression's labels."""
    known = {c for x in [*spec.ixs, spec.iy] for c in x}
    out: dict[str, int] = {}
    for part in text.split(","):
        label, eq, n = (x.strip() for x in part.partition("="))
        if not eq or len(label) != 1:
            raise ValueError(f"--sizes: {part!r} isn't of the form label=size")
        if label not in known:
            raise ValueError(f"--sizes: the expression has no label {label!r}")
        if not n.isdigit() or int(n) < 1:
            raise ValueError(f"--sizes: {label!r} needs a whole number of at least 1, not {n!r}")
        out[label] = int(n)
    return out


def betas_of(text: str) -> list[float]:
    """start:step:stop as a list."""
    try:
        start, step, stop = map(float, text.split(":"))
    except ValueError:
        raise ValueError(f"--betas: {text!r} isn't of the form start:step:stop") from None
    if not step > 0:
        raise ValueError("the step of betas must be above 0")
    out, i = [], 0
    while start + i * step <= stop:
        out.append(start + i * step)
        i += 1
    if not out:
        raise ValueError(f"betas {text!r} are empty")
    return out


def run_optimize(args) -> None:
    spec = parse(args.expression)
    spec = spec.with_sizes(sizes_of(args.sizes, spec))
    if args.method == "greedy":
        options = {"alpha": args.alpha, "temperature": args.temperature}
    elif args.method == "treesa":
        options = {
            "ntrials": args.ntrials, "niters": args.niters, "betas": betas_of(args.betas), "sc_target": args.sc_target,
            "tc_weight": args.tc_weight, "sc_weight": args.sc_weight, "rw_weight": args.rw_weight,
        }
    else:
        raise ValueError(f"--method: greedy or treesa, not {args.method!r}")
    spec = optimize(spec, args.method, **options)
    json_io.write_json(json_io.topology_document(args.expression, spec, args.method), args.output, args.pretty)


def chosen(args) -> EinsumSpec:
    if args.topology and args.expr:
        raise ValueError("give one of --topology and --expr, not both")
    if not args.topology and not args.expr:
        raise ValueError("one of --topology and --expr is needed")
    return json_io.read_topology(args.topology) if args.topology else parse(args.expr)


def folder_of(args) -> str:
    if not args.output:
        raise ValueError("--parts needs an --output folder")
    return args.output


def run_contract(args) -> None:
    spec = chosen(args)
    tensors, order = json_io.read_tensors(session(), args.tensors)
    result = einsum(spec, *tensors)
    if args.parts:
        json_parts.write_result(folder_of(args), result, order)
    else:
        json_io.write_json(json_io.result_document(result, order), args.output, args.pretty)


def run_autodiff(args) -> None:
    spec = chosen(args)
    spark = session()
    tensors, order = json_io.read_tensors(spark, args.tensors)
    result, grad = einsum_with_grad(spec, *tensors)
    if args.grad_output:
        dy = json_io.read_seed(spark, args.grad_output, result.dtype.name, order, result.shape)
    elif result.ndim:
        raise ValueError("--grad-output is needed unless the result is a scalar")
    else:
        dy = TensorRel.scalar(spark, 1, result.dtype)
    grads = grad.backward(dy, tensors)
    if args.parts:
        json_parts.write_gradients(folder_of(args), result, grads, order)
    else:
        json_io.write_json(json_io.gradient_document(result, grads, order), args.output, args.pretty)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tensorloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, about):
        c = sub.add_parser(name, help=about)
        c.set_defaults(run=run)
        c.add_argument("-o", "--output", help="file to write; standard output if absent")
        c.add_argument("--pretty", action="store_true", help="indent the JSON")
        return c

    o = command("optimize", run_optimize, "find a contraction order")
    o.add_argument("expression")
    o.add_argument("--sizes", required=True, help="label=size,...")
    o.add_argument("--method", default="greedy")
    o.add_argument("--alpha", type=float, default=0.0)
    o.add_argument("--temperature", type=float, default=0.0)
    o.add_argument("--ntrials", type=int, default=10)
    o.add_argument("--niters", type=int, default=2, help="sweeps at each of the betas")
    o.add_argument("--betas", default="0.01:0.5:14.51", help="inverse temperatures, start:step:stop")
    o.add_argument("--sc-target", type=float, default=20.0)
    o.add_argument("--tc-weight", type=float, default=1.0)
    o.add_argument("--sc-weight", type=float, default=1.0)
    o.add_argument("--rw-weight", type=float, default=0.0)
    for name, run, about in (("contract", run_contract, "contract tensors"), ("autodiff", run_autodiff, "contract tensors and find gradients")):
        c = command(name, run, about)
        c.add_argument("tensors")
        c.add_argument("-t", "--topology")
        c.add_argument("--expr")
        c.add_argument("--parts", action="store_true", help="write a folder of parts, by tasks, for results that are larger than the driver")
        if name == "autodiff":
            c.add_argument("--grad-output")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except (ValueError, KeyError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
