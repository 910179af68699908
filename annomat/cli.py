"""Command line: ``python -m annomat.cli convert|inspect|validate|snapshot|merge``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from annomat import api
from annomat.errors import AnnotatedMatrixError
from annomat.operators.validate import Qualifier, Schema
from annomat.sources.chunks import CHUNK_SIZE


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="annomat")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *positional: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for x in positional:
            v.add_argument(x)
        v.add_argument("--assay", default="RNA")
        v.add_argument("--layer", default="counts")
        v.add_argument("--chunk-size", type=int, default=CHUNK_SIZE)
        return v

    c = verb("convert", "input", "output")
    c.add_argument("--dtype", default="f32", choices=("f32", "f64", "i32", "u32"))
    c.add_argument("--x-slot", default="auto")
    c.add_argument("--project", default="SeuratProject")
    c.add_argument("--seuratdisk-compat", action="store_true", dest="compat")
    c.add_argument("--dgcmatrix", action="store_false", dest="packed")
    c.add_argument("--source-url")
    c.add_argument("--format", choices=("bundle", "npy", "bpcells", "h5ad", "h5seurat"))
    verb("inspect", "input")
    v = verb("validate", "input")
    v.add_argument("--schema")
    v.add_argument("--json", action="store_true")
    v.add_argument("--min-obs", type=int)
    v.add_argument("--dtype")
    v.add_argument("--has-layer", action="append", default=[])
    s = verb("snapshot", "input", "output")
    either = s.add_mutually_exclusive_group()
    either.add_argument("--only")
    either.add_argument("--exclude")
    m = verb("merge", "base", "output")
    m.add_argument("--patch", action="append", default=[])
    m.add_argument("--policy", "--on-conflict", default="error", choices=("error", "skip", "overwrite"))
    m.add_argument("--tag", action="append", default=[], help="key=value for the record")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """0 if all is well, 1 for a dataset that fails its validation."""
    where = {"assay": args.assay, "layer": args.layer, "chunk_size": args.chunk_size}
    if args.verb == "convert":
        print(api.convert(spark, args.input, args.output, dtype=args.dtype, x_slot=args.x_slot, project=args.project, compat=args.compat, source_url=args.source_url, format=args.format, packed=args.packed, **where))
    elif args.verb == "inspect":
        print(api.inspect(spark, args.input, **where))
    elif args.verb == "snapshot":
        print(api.snapshot(spark, args.input, args.output, args.only, args.exclude, **where))
    elif args.verb == "merge":
        print(api.merge(spark, args.base, args.patch, args.output, args.policy, dict(x.split("=", 1) for x in args.tag), **where))
    else:
        schema = Schema.load(args.schema) if args.schema else Schema()
        flags = {"obs": Qualifier(">=", args.min_obs)} if args.min_obs is not None else {}
        flags |= {"x_dtype": args.dtype} if args.dtype else {}
        flags |= {"layers": [*schema.layers, *args.has_layer]} if args.has_layer else {}
        schema = Schema(**{**schema.__dict__, **flags})
        report = api.validate(spark, args.input, schema, **where)
        print(report.json(args.input, args.schema or "") if args.json else report.text())
        return int(not report.passed)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("annomat").getOrCreate()
    try:
        return run(spark, args)
    except (AnnotatedMatrixError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
