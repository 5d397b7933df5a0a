import sys

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("module", ["pairlens.llm", "pairlens.llm.catalogue", "xxhash"])
def test_other_queries_stay_when_corpus_modules_cannot_be_imported(monkeypatch, module):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("pairlens.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, module, None)
    with pytest.warns(UserWarning, match="corpus"):
        names = set(entry.queries())
    assert "q_pnl_curve" in names and not [n for n in names if n.startswith("op")]
    with pytest.warns(UserWarning, match="corpus"):
        assert set(entry.oracle_sql()) <= names


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
