"""The entry module, with and without the training-data part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5


def test_without_the_training_data_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "reachway"), tmp_path / "reachway", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(q) == set(o), len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def test_a_broken_part_is_logged_and_left_out(tmp_path):
    shutil.copytree(os.path.join(ROOT, "reachway"), tmp_path / "reachway", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "reachway" / "llm").mkdir()
    (tmp_path / "reachway" / "llm" / "__init__.py").write_text("")
    (tmp_path / "reachway" / "llm" / "queries.py").write_text("import no_such_library\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0 and int(run.stdout) > 40 and "no_such_library" in run.stderr


def test_nothing_else_imports_the_training_data_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "reachway")):
        for n in names:
            if n.endswith(".py") and "llm" not in os.path.relpath(folder, ROOT).split(os.sep):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "llm" not in f.read(), n
