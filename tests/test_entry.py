import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(rows):
    told = lambda v: "" if v is None else round(float(v) + 0.0, 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(told, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    told = duck.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == sorted(told.columns)
    columns = sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    assert plain(rows) == plain(told.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "a broken module"])
def test_the_corpus_part_may_be_missing_but_not_broken(tmp_path, left):
    top = Path(entry.__file__).parent
    shutil.copytree(top / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        (tmp_path / "tidemark/llm").mkdir()
    if left == "a broken module":
        (tmp_path / "tidemark/llm/__init__.py").write_text("")
        (tmp_path / "tidemark/llm/queries.py").write_text("import no_such_module_anywhere")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    if left == "a broken module":
        assert "no_such_module_anywhere" in done.stderr
    else:
        assert done.stdout.split()[-2:] == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))], done.stderr
