import subprocess
import sys
from pathlib import Path
from shutil import copytree, ignore_patterns

ROOT = Path(__file__).resolve().parent.parent


def test_entry_gives_the_scoreboard(spark):
    import __spark_entry__ as e

    t = e.entry(spark)
    assert {"model", "pooled_rmse", "macro_component_rmse", "tail_rmse"} <= set(t.columns) and t.count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_works_without_the_training_text_subpackage(tmp_path):
    copytree(ROOT, tmp_path / "repo", ignore=ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a04_model_metrics' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_it():
    for f in (ROOT / "cairn").rglob("*.py"):
        if "llm" not in f.parts:
            assert "cairn.llm" not in f.read_text(), f
