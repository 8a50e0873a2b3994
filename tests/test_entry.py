import ast
import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"type", "count"}


def test_nothing_else_imports_the_training_text_part():
    for path in (ROOT / "sqlquarry").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or n == "corpus_pipeline" for n in names), path


def test_entry_without_the_training_text_part(tmp_path):
    for name in ("__spark_entry__.py", "sqlquarry"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (tmp_path / "sqlquarry").mkdir()
    for path in (ROOT / "sqlquarry").iterdir():
        if path.name != "llm":
            os.symlink(path, tmp_path / "sqlquarry" / path.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'query_type_counts' in q and not any(n.startswith('op') for n in q), q; assert e.oracle_sql()"
    code += """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert e.entry(spark).count() > 3 and q['column_usages'](spark, '/root/testdata/sf0.001').count() > 3
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_with_a_part_that_cannot_be_imported(tmp_path):
    """A package that is there but lacks one of its own needs is left out, too."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
sys.modules['tokenizers'] = None
import __spark_entry__ as e
assert 'query_type_counts' in e.queries() and e.oracle_sql() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
