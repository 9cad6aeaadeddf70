"""The entry module with the optional part whole, absent, left empty, or lacking a dependency."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q, any(n.startswith('op') for n in q))"


def asked(folder, before=""):
    out = subprocess.run([sys.executable, "-c", before + ASK], cwd=folder, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": folder})
    return out.stdout.split()


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(os.path.join(ROOT, "verbaloom"), tmp_path / "verbaloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    return tmp_path


def test_without_the_optional_part(copy):
    absent = asked(str(copy))
    assert int(absent[0]) > 60 and absent[2:] == ["False", "False"]
    (copy / "verbaloom" / "llm" / "__pycache__").mkdir(parents=True)
    assert asked(str(copy)) == absent
    # a module that imports what is not there
    (copy / "verbaloom" / "llm" / "registry.py").write_text("import pyarrow.compute_that_is_missing\n")
    assert asked(str(copy)) == absent
    (copy / "corpus_pipeline.py").write_text("from verbaloom.llm import registry\n")
    assert asked(str(copy)) == absent


def test_a_blocked_dependency_leaves_the_other_queries():
    got = asked(ROOT, "import sys; sys.modules['pyarrow.compute'] = None; ")
    assert int(got[0]) > 60 and got[2] == "False"
