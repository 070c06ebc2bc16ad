import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("vecmill/llm", "tests/llm"), ("vecmill/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_stands_without_the_training_data_operators(tmp_path, gone):
    """A copy without them imports, offers all other queries, and its tests are collected."""
    for name in ("vecmill", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    for name in gone:
        remove = shutil.rmtree if (tmp_path / name).is_dir() else os.remove
        remove(tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, env=env, capture_output=True, text=True)
    kept = {n for n in entry.queries() if not (n.startswith("op") and "vecmill/llm" in gone) and n != "pipeline"}
    assert set(said.stdout.split()) == kept, said.stderr
    if "vecmill/llm" in gone:
        found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert found.returncode == 0, found.stdout[-2000:]


def test_only_what_may_be_missing_is_missing():
    assert entry._optional("vecmill.no_such_part") is None and entry._optional("no_such_package.part") is None
    (broken := ROOT / "tests" / "needs_what_is_not_there.py").write_text("import no_such_package\n")
    try:
        with pytest.raises(ModuleNotFoundError):
            entry._optional("tests.needs_what_is_not_there")
        assert entry._optional("tests.needs_what_is_not_there", needs="no_such_package") is None
    finally:
        broken.unlink()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["vec_id"] == 0 and rows[0]["similarity"] == 1


def test_statements_from_standard_input(tmp_path):
    """python -m vecmill reads a statement a line and goes on after errors."""
    lines = "CREATESTORE s DIMENSION 2\nSET (([1, 2], {a: b})) IN s; GETSIMN 1 WITH [1, 2] USING cosinesimilarity IN s\nnonsense\nDROPSTORE none; DROPSTORE s\n"
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    said = subprocess.run([sys.executable, "-m", "vecmill", "--no-interactive"], input=lines, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300).stdout
    assert "inserted=1" in said and "similarity" in said and said.count("error 3") == 1 and said.count("error 5") == 1 and "count=1" in said
