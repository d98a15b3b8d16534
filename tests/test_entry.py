"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["Name", "Segment", "Order", "Date"] and df.count() > 0


def test_without_the_subpackage(tmp_path):
    def skip(folder, names):
        return [n for n in names if n in ("llm", ".git", "corpus_pipeline.py", "__pycache__")]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan' in q and 'pipeline' not in q and not [n for n in q if n[:2] == 'op' and n[2].isdigit()]; assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
