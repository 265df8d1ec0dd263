"""Queries that are made of others run what these have in common once."""

import pytest

from tessel.operators import names as A
from tessel.plans import QUERIES
from tessel.plans import link_queries as Q
from tessel.plans import queries as P

SF = "/root/testdata/sf0.001"


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


@pytest.mark.parametrize("name", ["m07_stage_publication", "m10_flow_table"])
def test_stages_and_publication_come_from_one_flow(spark, monkeypatch, name):
    flows = counted(monkeypatch, P.G, "seeds")
    assert QUERIES[name](spark, SF).collect() and len(flows) == 1


def test_names_shared_with_peers_need_no_registry(spark, monkeypatch):
    compared = counted(monkeypatch, A, "compared_names")
    assert QUERIES["l10_name_shares"](spark, SF).collect() and not compared


def test_links_are_built_once(spark, monkeypatch):
    links = counted(monkeypatch, Q.L, "links")
    assert QUERIES["q13_shared_values"](spark, SF).collect() and len(links) == 1
    assert not P._SHARED


def test_invariants_build_evidence_once(spark, monkeypatch):
    calls = [counted(monkeypatch, m, f) for m, f in ((Q.L, "links"), (Q.R, "record_versions"), (Q.R, "link_records"))]
    rows = QUERIES["i00_invariants"](spark, SF).collect()
    assert {r.sound for r in rows if r.invariant != "membership"} == {0}
    assert [len(c) for c in calls] == [1, 1, 1] and not P._SHARED
