"""The driver contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, sum(n.startswith('op') for n in q))"


def _names(root):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def _copy(to, *without):
    shutil.copytree(os.path.join(ROOT, "promptgrid"), to / "promptgrid", ignore=shutil.ignore_patterns("__pycache__", *without))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), to / name)
    return to


def test_imports_without_the_corpus_operators(tmp_path):
    from promptgrid.plans import queries

    n = str(len(queries.queries()))
    for i, without in enumerate((("llm",), ("llm", "corpus_pipeline.py"))):
        (tmp_path / str(i)).mkdir()
        assert _names(_copy(tmp_path / str(i), *without)) == [n, "False", "0"]
