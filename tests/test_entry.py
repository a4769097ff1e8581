"""The driver's contract: what is registered, and what may be missing."""

import sys

import pytest

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


@pytest.mark.parametrize(("missing", "tolerated"), [("tesserae.llm", True), ("tesserae.llm.registry", True), ("tesserae.llm.secrets", False), ("numpy", False)])
def test_only_the_subpackage_itself_may_be_missing(monkeypatch, missing, tolerated):
    """A module that the subpackage wants and that is not there is an error, not a reason to leave the subpackage out."""
    pytest.importorskip("tesserae.llm")
    for name in [m for m in sys.modules if m.startswith("tesserae.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    if tolerated:
        assert entry._extra() == ({}, {})
    else:
        with pytest.raises(ImportError):
            entry._extra()
