import pytest

from arborlake.sources import code


def test_go_imports():
    source = 'package a\nimport "fmt"\nimport x "example.org/a/b"\nimport (\n  "os"\n  // "no.example/c"\n  y "other.dev/z"\n)\n'
    assert code.go_imports(source) == ["example.org/a/b", "other.dev/z"]


def test_python_imports():
    source = "import os, numpy as np\nfrom . import sib\nfrom ..up import x\nfrom pkg.mod import y\n"
    assert code.python_imports(source, "a.b.c") == ["a.b", "a.up", "numpy", "pkg.mod"]
    assert code.python_imports("not python (") == []
    assert code.resolve_module("a.b.c", {"a", "a.b"}) == "a.b" and code.resolve_module("z.y", {"a"}) == "z.y"


def test_weights_are_checked():
    assert code.read_weights('{"stars": 2, "novelty": 0.5}') == {"stars": 2.0, "novelty": 0.5}
    for bad in ('{"stars": 3}', '{"moon": 1}', '{"stars": "x"}', '{"stars": true}'):
        with pytest.raises(ValueError):
            code.read_weights(bad)


def test_lanes():
    assert code.read_lanes(" A, b,a", ("a", "b")) == ["a", "b"]
    with pytest.raises(ValueError):
        code.read_lanes("c", ("a", "b"))
