import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_corpus_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": ""}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=env)
    # folders that only hold caches, or a package that can't be imported, are left out too
    (tmp_path / "r" / "tessella" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=env)
    (tmp_path / "r" / "tessella" / "llm" / "__init__.py").write_text("import a_module_that_is_not_there\n")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=env)


def test_library_does_not_import_the_corpus_parts():
    for p in (ROOT / "tessella").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tessella.llm" not in p.read_text(), p
