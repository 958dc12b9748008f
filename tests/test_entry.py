"""The library stands without its corpus subpackage."""
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_corpus_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "riskweave"), copy / "riskweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    corpus = os.path.join(ROOT, "corpus_pipeline.py")
    code = ("import __spark_entry__ as E; from riskweave.plans import catalog as C; "
            "assert set(E.queries()) == set(C.QUERIES) and set(E.oracle_sql()) == set(C.ORACLE)")
    for left_behind in (False, True):                      # with and without the pipeline's file at the top
        if left_behind and os.path.exists(corpus):
            shutil.copy(corpus, copy)
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120,
                              env={**os.environ, "PYTHONPATH": str(copy)})
        assert done.returncode == 0, done.stderr
