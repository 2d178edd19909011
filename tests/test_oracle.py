"""Every registered query with SQL against DuckDB, over whole tables of the smallest size."""

import pytest

from curatrix import catalog


def rows(names, values):
    """Rows with columns by name, floats rounded, in one order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "NULL" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    top = pathlib.Path(catalog.__file__).parent
    for f in top.rglob("*.py"):
        if "llm" not in f.relative_to(top).parts:
            assert not re.search(r"^\s*(from|import) curatrix\.llm", f.read_text(), re.M), f
