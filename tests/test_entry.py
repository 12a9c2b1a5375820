import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_training_data_operators(tmp_path):
    """The subpackage, its tests and the pipeline may be deleted."""
    copy = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "pagewright"), copy / "pagewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, sql, any_op = said.stdout.split()
    assert int(n) >= 40 and int(sql) >= 40 and any_op == "False"
