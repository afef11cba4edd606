"""The driver contract: every registered query is mapped to a survey operator
in tools/inventory.py, oracle keys are a subset of query keys, and every
oracle statement at least parses in DuckDB."""

import importlib.util
import os
import re

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _inventory_rows():
    spec = importlib.util.spec_from_file_location("inventory", os.path.join(ROOT, "tools", "inventory.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod.ROWS


def test_inventory_covers_registry():
    import __spark_entry__ as E

    mapped = {k.strip() for *_, reg in _inventory_rows() for k in reg.split(",") if k.strip()}
    # the training-data queries are an optional part with an inventory of its own
    assert mapped == {q for q in E.queries() if q != "pipeline" and not re.match(r"op\d+_", q)}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracle_sql_binds_in_duckdb():
    import __spark_entry__ as E
    from quire.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in E.oracle_sql().items():
        con.execute(f"DESCRIBE {sql}")  # parses and binds without running the query


def test_works_without_the_training_data_part():
    """What is deleted with that part may be absent; other import errors are raised."""
    import subprocess
    import sys
    import textwrap

    code = """
    import sys
    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name == "quire.llm" or name.startswith("quire.llm.") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=sys.argv[1] or name)
    sys.meta_path.insert(0, Absent())
    import __spark_entry__ as E
    names = set(E.queries())
    assert "clean_text" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
    assert set(E.oracle_sql()) <= names
    """
    run = lambda arg: subprocess.run([sys.executable, "-c", textwrap.dedent(code), arg], cwd=ROOT, capture_output=True, text=True)
    assert run("").returncode == 0
    assert run("tokenizers").returncode != 0  # an operator's own import error is not swallowed


def test_nothing_imports_the_training_data_part():
    import pathlib
    import re

    for f in pathlib.Path(ROOT, "quire").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"quire\.llm|corpus_pipeline|from quire import llm", f.read_text()), f
