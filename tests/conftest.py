"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from palimpsest.session import local

    session = local(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _tables():
    return sorted(Path(DATA).glob("*.parquet"))


@pytest.fixture(scope="session")
def empty_folder(tmp_path_factory):
    """All tables without a row."""
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("empty")
    for p in _tables():
        pq.write_table(pq.read_table(p).slice(0, 0), folder / p.name)
    return str(folder)


@pytest.fixture(scope="session")
def null_folder(tmp_path_factory):
    """All tables with five rows of nulls in every column, and five rows as they are."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("nulls")
    for p in _tables():
        t = pq.read_table(p)
        nulls = pa.table({f.name: pa.nulls(5, f.type) for f in t.schema}, schema=t.schema)
        pq.write_table(pa.concat_tables([nulls, t.slice(0, 5)]), folder / p.name)
    return str(folder)


@pytest.fixture(scope="session")
def twice_folder(tmp_path_factory):
    """All tables with their first rows twice, so that keys repeat and everything ties."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("twice")
    for p in _tables():
        t = pq.read_table(p).slice(0, 40)
        pq.write_table(pa.concat_tables([t, t]), folder / p.name)
    return str(folder)
