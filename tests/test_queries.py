import builtins
import importlib
import sys

import pytest

from gristmill.plans import catalog

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(same_as_sql, name):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry_works_without_the_optional_parts(spark, monkeypatch):
    real = builtins.__import__

    def refuse(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("gristmill.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", refuse)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries().keys() == catalog.QUERIES.keys()
    assert entry.oracle_sql() == catalog.ORACLE_SQL
    assert entry.entry(spark).count() > 0


def test_broken_parts_are_not_hidden(monkeypatch):
    real = builtins.__import__

    def broken(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("gristmill.llm"):
            raise ModuleNotFoundError("No module named 'numpy'", name="numpy")
        return real(name, globals, locals, fromlist, level)

    import __spark_entry__ as entry

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
