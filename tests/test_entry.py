"""The entry module with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CORPUS = ("vanewright/llm", "tests/llm", "corpus_pipeline.py")


@pytest.mark.parametrize("gone", [CORPUS[:2], CORPUS, CORPUS[2:]])
def test_queries_without_the_corpus_operators(tmp_path, gone):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", ".*"))
    for name in gone:
        path = root / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), *sorted(k for k in q if k == 'pipeline' or k.startswith('op')))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=False, timeout=120)
    assert out.returncode == 0, out.stderr
    n, *names = out.stdout.split()
    assert int(n) > 100 and "pipeline" not in names
    assert bool(names) == (gone == CORPUS[2:] and os.path.isdir(os.path.join(ROOT, "vanewright/llm")))
