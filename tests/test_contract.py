"""The driver's entry points with and without the optional modules."""

import sys

import pytest

import __spark_entry__ as contract
from dataloupe.catalog import QUERIES, SQL


def test_without_the_optional_modules(monkeypatch):
    for name in contract.OPTIONAL:
        monkeypatch.setitem(sys.modules, name, None)  # importing it raises ImportError
    assert set(contract.queries()) == set(QUERIES)
    assert set(contract.oracle_sql()) == set(SQL)



def test_an_import_that_an_optional_module_needs_is_not_passed_over(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("no such thing", name="dataloupe.llm.misspelt")

    monkeypatch.setattr(contract.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        contract.queries()


def test_the_flagship_is_a_query():
    assert contract.FLAGSHIP in contract.queries()
