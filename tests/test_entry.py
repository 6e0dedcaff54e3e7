import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def counts(root: Path) -> list[str]:
    run = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=root, capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_entry_without_the_training_data_part(tmp_path):
    away = shutil.ignore_patterns("llm", "__pycache__", ".git", ".hypothesis", ".pytest_cache")
    for left in (("corpus_pipeline.py",), ()):
        root = tmp_path / str(len(left))
        shutil.copytree(ROOT / "saltmarsh", root / "saltmarsh", ignore=away)
        for name in ("__spark_entry__.py", *left):
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, root / name)
        queries, sql, pipeline = counts(root)
        assert int(queries) >= 139 and int(sql) >= 138 and pipeline == "False"


def test_an_error_inside_the_training_data_part_is_not_hidden(tmp_path):
    away = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "saltmarsh", tmp_path / "saltmarsh", ignore=away)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "saltmarsh/llm").mkdir()
    (tmp_path / "saltmarsh/llm/__init__.py").write_text("")
    (tmp_path / "saltmarsh/llm/queries.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert run.returncode and "no_such_module" in run.stderr
