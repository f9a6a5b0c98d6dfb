"""Command line: python -m skein.cli INPUT [options] prints a file's diagram."""

from __future__ import annotations

import argparse
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from skein import __version__
from skein.api import session
from skein.params import RipsError, RipsParams, rust_float
from skein.plans.rips import MetricSpace, rips_persistence
from skein.sinks import collected, csv_text, interval_text
from skein.sources.files import FORMATS, infer_format, read_space


def git_hash() -> str:
    """The commit of a checkout, or `unknown`."""
    try:
        return subprocess.run(["git", "-C", str(Path(__file__).parent), "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def _whole(text: str) -> int:
    if not text.isdigit():
        raise argparse.ArgumentTypeError(f"not a whole number: {text}")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein", description="Persistent homology of Vietoris-Rips filtrations")
    p.add_argument("input", help="file of points or distances")
    p.add_argument("--format", choices=FORMATS, help="by default from the file's extension; never sparse")
    p.add_argument("--dim", type=_whole, default=1, help="highest homology dimension")
    p.add_argument("--threshold", type=float, help="largest diameter")
    p.add_argument("--modulus", type=_whole, default=2, help="prime of the coefficients")
    p.add_argument("--threads", type=_whole, default=1, help="a hint at parallelism")
    p.add_argument("--output", choices=("ripser", "csv"), default="ripser")
    p.add_argument("--version", action="version", version=f"skein {__version__} ({git_hash()}, release)")
    for name in ("emergent-pairs", "apparent-pairs", "clearing"):
        p.add_argument(f"--no-{name}", action="store_true", help=argparse.SUPPRESS)
    return p


def _about(space: MetricSpace, threshold: float | None) -> tuple[int, str]:
    n = space.vertices.count()
    if space.kind == "sparse":
        limit = "no threshold (all listed edges)" if threshold is None else f"threshold {rust_float(threshold)}"
        return n, f"{n} points, {space.edges.count()} edges, {limit}"
    if threshold is not None:
        return n, f"{n} points, threshold {rust_float(threshold)}"
    radius = space.enclosing_radius().agg(F.coalesce(F.max("radius"), F.lit(0.0))).first()[0]
    return n, f"{n} points, threshold {rust_float(radius)} (enclosing radius)"


def main(argv: list[str] | None = None) -> int:
    """Runs the command and returns its exit code: 0, 1 on errors, argparse's own for faulty usage."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return e.code or 0
    params = RipsParams(args.dim, args.threshold, args.modulus, max(args.threads, 1), not args.no_emergent_pairs, not args.no_apparent_pairs, not args.no_clearing)
    try:
        space = read_space(session(), args.input, args.format or infer_format(args.input))
        n, about = _about(space, args.threshold)
        print(about, file=sys.stderr)
        bars = collected(rips_persistence(space, params))
    except RipsError as e:
        print(f"skein: {e}", file=sys.stderr)
        return 1
    sys.stdout.write(csv_text(bars) if args.output == "csv" else interval_text(bars, min(args.dim, max(n - 1, 0))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
