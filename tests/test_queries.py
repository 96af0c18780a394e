import pytest

from tests.conftest import SMALL

from blockwright.plans.queries import ORACLES, QUERIES


def rows(frame):
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got) > 0 or name == "screen_misses"
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_rest_works_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/blockwright", tmp_path / "blockwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(x.startswith('op') for x in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.split() == [str(len(QUERIES)), "False"], done.stderr


def test_modelled_codecs_take_whole_documents(spark):
    rows = QUERIES["roundtrip_modelled_documents"](spark, SMALL).groupBy("codec").max("n_bytes").collect()
    assert len(rows) == 3 and all(r[1] > 4096 for r in rows)  # more than a block
