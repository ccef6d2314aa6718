"""The entry module registers its queries with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def listed(folder):
    done = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_entry_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    for name in ("spendspark", "checks"):
        shutil.copytree(f"{ROOT}/{name}", copy / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", copy)
    alone = listed(copy)
    assert len(alone) >= 138 and "actions_expenses" in alone and not [n for n in alone if n.startswith("op")]
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        # the pipeline's file without the operators it imports
        shutil.copy(f"{ROOT}/corpus_pipeline.py", copy)
        assert listed(copy) == alone
    assert alone <= listed(ROOT)
