"""The driver's contract holds without the language-model subpackage."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [set(line.split()) for line in out.stdout.splitlines()]


def test_catalogue_without_the_subpackage(tmp_path):
    """With nava/llm deleted, beside corpus_pipeline.py or without it, the other queries are all there."""
    from nava.plans import catalogue

    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(TOP, "nava"), copy / "nava", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(TOP, name)):
            shutil.copy(os.path.join(TOP, name), copy / name)
    wanted = [set(catalogue.queries()), set(catalogue.oracle_sql())]
    assert listed(copy) == wanted
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed(copy) == wanted
