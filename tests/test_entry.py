import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_run_from_another_folder(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r})\nimport __spark_entry__ as e\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\nprint(e.entry(s).count(), e.queries()['doc_sentence_chunks'](s, '/root/testdata/sf0.001').count())"
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-800:]
    assert all(int(x) > 0 for x in out.stdout.split()[-2:])


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "tempoloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "tempoloom.llm" not in f.read_text(), f
