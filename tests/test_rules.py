"""Rules bound to the given tables, on their awkward rows."""

import pytest

from tessergrid import registry
from tessergrid.plans import identity_queries, ledger_queries, recall_queries, selection_queries
from tessergrid.plans import rule_queries as Q
from tessergrid.plans.bound import AwkwardRows, Bound, Clause, Words, on_rows
from tests.conftest import table_of

MODULES = [Q, identity_queries, ledger_queries, recall_queries, selection_queries]
INPUTS = [v for m in MODULES for v in vars(m).values() if isinstance(v, (Bound, Clause, Words))]
INPUTS += [b for b in identity_queries.BOUND.values() if b.select]


def uses(q):
    return [b for b in INPUTS if q.sql and b.sql in q.sql]


CASES = sorted(n for n, q in registry.QUERIES.items() if any(isinstance(b, Bound) for b in uses(q)))


@pytest.mark.parametrize("name", CASES)
def test_awkward_rows(name, spark, duck):
    q = registry.QUERIES[name]
    df = q.run(AwkwardRows(spark))
    want = duck.sql(on_rows(q.sql, *uses(q)))
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of(want.columns, want.fetchall())


def test_prefixes(spark):
    got = {(r["code"], r["subject_code"]): r["prefix"] for r in Q.prefix_context(AwkwardRows(spark)).collect()}
    assert got[("6.003", None)] == "6" and got[("21W.735", "")] == "21w" and got[("CS61A", None)] == "cs" and got[(None, "AFAM ")] == "afam" and got[("_x", None)] == "" and got[("HIST 101", "HIST")] == "hist"


@pytest.mark.parametrize("name", sorted(identity_queries.WANTED))
def test_awkward_outcomes(name, spark):
    """What a rule must say of each awkward case, written out."""
    df, want = registry.QUERIES[name].run(AwkwardRows(spark)), identity_queries.WANTED[name].frame(spark)
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of(want.columns, [tuple(r) for r in want.collect()])
