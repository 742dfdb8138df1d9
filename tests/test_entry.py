"""The entry module, and the layering that lets the corpus subpackage be left out."""

import ast
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def imports(path: str) -> set[str]:
    tree = ast.parse(open(path).read())
    out = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            out.add(node.module or "")
    return out


def test_nothing_else_imports_the_corpus_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "twinsift")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                assert not any(m.startswith("twinsift.llm") for m in imports(os.path.join(folder, n))), n


def test_queries_remain_without_it(tmp_path):
    shutil.copytree(os.path.join(ROOT, "twinsift"), tmp_path / "twinsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_queries_remain_without_a_library_of_it(tmp_path):
    (tmp_path / "tiktoken.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"})


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["rep_a", "rep_b", "distance"] and df.count() >= 0


def test_parameters():
    import pytest

    from twinsift.params import TYPES, IndexParams, SearchParams, parse_flags

    assert SearchParams(alg="video").result_types() == 3 and SearchParams().result_types() == 1
    assert SearchParams(alg="video", types=1).result_types() == 1
    assert parse_flags("image+audio", TYPES) == 5 and parse_flags("2", TYPES) == 2 and parse_flags(7, TYPES) == 7
    for bad in (lambda: SearchParams(dht=99), lambda: IndexParams(fsize=-1), lambda: parse_flags("x", TYPES)):
        with pytest.raises(ValueError):
            bad()
