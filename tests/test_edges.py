"""Constructors, files, text output and the command line."""

import math

import pytest

from skein import api, cli
from skein.params import IndexOverflow, InputOutput, InvalidDistance, InvalidInput, RipsError, RipsParams, checked_dim, rust_float
from skein.plans.rips import rips_persistence
from skein.sinks import csv_text, interval_text
from skein.sources import files, memory

INF = float("inf")
SQUARE = [[0, 0], [1, 0], [1, 1], [0, 1]]
CYCLE = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 1.0)]


def test_python_functions(spark):
    bars = api.rips_points(SQUARE)
    assert bars == [(0, 0.0, 1.0)] * 3 + [(0, 0.0, INF), (1, 1.0, math.sqrt(2))]
    pdist = [1.0, math.sqrt(2), 1.0, 1.0, math.sqrt(2), 1.0]
    assert api.rips_condensed(pdist, threads=2) == bars
    assert [b[2] for b in api.rips_condensed([0.5, 0.5, 1, 10, 5, 6], max_dim=0)] == [0.5, 0.5, 1.0, INF]
    assert api.rips_sparse(4, CYCLE) == [(0, 0.0, 1.0)] * 3 + [(0, 0.0, INF), (1, 1.0, INF)]
    assert api.rips_points([]) == [] and api.rips_points([[1, 2]]) == [(0, 0.0, INF)] and api.rips_points([[3, 4]] * 2) == [(0, 0.0, INF)]
    assert api.rips_points([[], []]) == [(0, 0.0, INF)]
    assert api.rips_condensed([INF]) == [(0, 0.0, INF)] * 2 and api.rips_condensed([]) == [(0, 0.0, INF)]
    assert api.rips_sparse(5, [], max_dim=2) == [(0, 0.0, INF)] * 5
    assert api.rips_sparse(3, [(0, 1, 1.5)]) == [(0, 0.0, 1.5)] + [(0, 0.0, INF)] * 2
    assert api.rips_condensed([1, 2, 3], threshold=0) == [(0, 0.0, INF)] * 3


@pytest.mark.parametrize(
    ("call", "kind", "says"),
    [
        (lambda s: memory.from_condensed(s, [1, 2]), InvalidInput, "condensed length 2"),
        (lambda s: memory.from_condensed(s, [math.nan]), InvalidDistance, "NaN at condensed index 0"),
        (lambda s: memory.from_condensed(s, [-1.0]), InvalidDistance, "negative entry -1 at"),
        (lambda s: memory.from_points(s, [[1.0], [1.0, 2.0]]), InvalidInput, "2 coordinates, expected 1"),
        (lambda s: memory.from_points(s, [[INF]]), InvalidInput, "non-finite"),
        (lambda s: memory.from_triplets(s, 2, [(0, 2, 1.0)]), InvalidInput, "out of range"),
        (lambda s: memory.from_triplets(s, 2, [(1, 1, 1.0)]), InvalidInput, "self-distance"),
        (lambda s: memory.from_triplets(s, 2, [(0, 1, INF)]), InvalidDistance, "finite and non-negative"),
        (lambda s: memory.from_triplets(s, 2, [(0, 1, 1.0), (1, 0, 2.0)]), InvalidInput, "conflicting distances for pair (0, 1): 1 vs 2"),
        (lambda s: api.rips_points([], threshold=-1), InvalidInput, "threshold"),
        (lambda s: api.rips_points([], threshold=math.nan), InvalidInput, "threshold"),
        (lambda s: api.rips_points(SQUARE, modulus=4), InvalidInput, "prime"),
        (lambda s: api.rips_points(SQUARE, modulus=32771), InvalidInput, "prime"),
        (lambda s: memory.from_point_frame(s.createDataFrame([(0, 0, [1.0, None])], "g long, p long, c array<double>"), "g", "p", "c"), InvalidInput, "null"),
        (lambda s: memory.from_point_frame(s.createDataFrame([(0, 0, [1.0]), (0, 1, [1.0, 2.0])], "g long, p long, c array<double>"), "g", "p", "c"), InvalidInput, "different dimensions"),
    ],
)
def test_faults(spark, call, kind, says):
    with pytest.raises(kind) as e:
        call(spark)
    assert says in str(e.value) and isinstance(e.value, ValueError)


def test_limits():
    assert RipsParams(modulus=32749).with_threshold(-0.0).with_threads(3).with_modulus(2).validate().threads == 3
    assert checked_dim(4, 2**64 - 1) == 3 and checked_dim(0, 5) == 0
    assert checked_dim(3_810_779, 1) == 1
    for n, dim, modulus in ((4_801_281, 1, 2), (145_057, 2, 2), (150_041, 1, 32749), (70, 69, 2)):
        with pytest.raises(IndexOverflow) as e:
            checked_dim(n, dim, modulus)
        assert f"overflows u64 for {n} points" in str(e.value)


def test_repeated_triplets_and_zeros(spark):
    space = memory.from_triplets(spark, 3, [(0, 1, 0.0), (1, 0, -0.0), (1, 2, 1.0)])
    assert space.edges.count() == 2 and all(math.copysign(1, r.d) == 1 for r in space.edges.collect())


def test_text_output():
    bars = [(0, 0.0, 0.25), (0, 0.0, INF), (1, 0.5, 1.0)]
    assert interval_text(bars, 1) == "persistence intervals in dim 0:\n [0,0.25)\n [0, )\npersistence intervals in dim 1:\n [0.5,1)\n"
    assert csv_text(bars) == "dim,birth,death\n0,0,0.25\n0,0,inf\n1,0.5,1\n"
    assert [rust_float(x) for x in (1e-7, 1e21, 1.0, 0.1, math.nan, -2.5)] == ["0.0000001", "1000000000000000000000", "1", "0.1", "NaN", "-2.5"]


def write(path, text):
    path.write_text(text, newline="")
    return str(path)


def test_files(spark, tmp_path):
    cloud = write(tmp_path / "a.CSV", "# square\n0,0\r\n\n 1 0\n,,\n1,\t1\n0.0e0 +1.\n")
    assert files.infer_format(cloud) == "point-cloud" and files.infer_format("x.dat") == "lower-distance"
    space = files.read_space(spark, cloud)
    assert space.vertices.count() == 4 and rips_persistence(space).where("dim = 1").count() == 1
    lower = files.read_space(spark, write(tmp_path / "b.dat", "\n1\n1.5 1,\n# x\n1 1.5\n1\n"))
    assert sorted((r.u, r.v, r.d) for r in lower.edges.collect()) == [(1, 0, 1.0), (2, 0, 1.5), (2, 1, 1.0), (3, 0, 1.0), (3, 1, 1.5), (3, 2, 1.0)]
    assert files.read_space(spark, write(tmp_path / "c", "")).vertices.count() == 1
    assert files.read_space(spark, write(tmp_path / "d.pts", "#\n")).vertices.count() == 0
    sparse = files.read_space(spark, write(tmp_path / "e", "0 1 1\n1,2,2\n2 1 2.0\n"), "sparse")
    assert sparse.vertices.count() == 3 and sparse.edges.count() == 2


@pytest.mark.parametrize(
    ("text", "form", "says"),
    [
        ("1.0 2\n1.0 oops\n", "point-cloud", ':2: not a number: "oops"'),
        ("1_0\n", "point-cloud", "not a number"),
        ("1.5d\n", "lower-distance", "not a number"),
        ("1\n2 3\n", "point-cloud", ":2: point has 2 coordinates, expected 1"),
        ("inf\n", "point-cloud", "non-finite"),
        ("nan", "lower-distance", "NaN at condensed index 0"),
        ("1 2", "lower-distance", "condensed length 2"),
        ("0 1\n", "sparse", ":1: expected 'i j d', got 2 fields"),
        (",,\n", "sparse", "got 0 fields"),
        ("0 -1 1\n", "sparse", "not a vertex index"),
        ("0 18446744073709551615 1\n", "sparse", "vertex index out of range"),
        ("0 1 x\n", "sparse", "not a number"),
        ("0 0 1\n", "sparse", "self-distance"),
        ("0 1 inf\n", "sparse", "finite and non-negative"),
    ],
)
def test_faulty_files(spark, tmp_path, text, form, says):
    with pytest.raises(RipsError) as e:
        files.read_space(spark, write(tmp_path / "f.txt", text), form)
    assert says in str(e.value)


def test_missing_file(spark, tmp_path):
    with pytest.raises(InputOutput):
        files.read_space(spark, str(tmp_path / "none"))


def test_command_line(spark, tmp_path, capsys):
    square = write(tmp_path / "s.csv", "0,0\n1,0\n1,1\n0,1\n")
    assert cli.main([square]) == 0
    out = capsys.readouterr()
    assert out.out == "persistence intervals in dim 0:\n [0,1)\n [0,1)\n [0,1)\n [0, )\npersistence intervals in dim 1:\n [1,1.4142135623730951)\n"
    assert out.err == "4 points, threshold 1.4142135623730951 (enclosing radius)\n"
    assert cli.main([square, "--dim", "18446744073709551615", "--no-clearing", "--threshold", "1"]) == 0
    out = capsys.readouterr()
    assert out.out.count("persistence intervals") == 4 and " [1, )" in out.out and out.err == "4 points, threshold 1\n"
    cycle = write(tmp_path / "c.txt", "0 1 1\n1 2 1\n2 3 1\n0 3 1\n")
    assert cli.main([cycle, "--format", "sparse", "--output", "csv"]) == 0
    out = capsys.readouterr()
    assert out.out == "dim,birth,death\n0,0,1\n0,0,1\n0,0,1\n0,0,inf\n1,1,inf\n" and out.err == "4 points, 4 edges, no threshold (all listed edges)\n"
    for arguments, says in ((["--modulus", "4"], "prime"), (["--threshold", "-1"], "threshold"), (["--threshold", "nan"], "threshold")):
        assert cli.main([square, *arguments]) == 1
        assert says in capsys.readouterr().err
    assert cli.main(["--version"]) == 0 and "0.1.0" in capsys.readouterr().out
    assert cli.main([square, "--dim", "x"]) == 2
