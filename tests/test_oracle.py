"""Every named query at the smallest scale against its SQL text."""

from __future__ import annotations

import collections
import itertools

import pytest

from panelspark import registry
from tools.check_oracle import compare, connect

registry.load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, con, sf, name):
    assert compare(spark, con, name, sf, may_be_empty=True) is None


def _scores(rows, valid):
    assert len(rows) == valid and all(0 <= r.prob <= 1 for r in rows)
    good, bad = ([r.prob for r in rows if r.tag == t] for t in (1, 0))
    assert sum(p > q for p in good for q in bad) + 0.5 * sum(p == q for p in good for q in bad) >= 0.4 * len(good) * len(bad)


def _search(rows):
    assert len(rows) == 10 and [r.rung for r in rows] == sorted((r.rung for r in rows), reverse=True)
    last = [r for r in rows if r.rung == rows[0].rung]
    assert len(last) == 2 and last[0].f1 >= last[1].f1 and all(0 <= r.f1 <= 1 and 1 <= r.trees <= 9 for r in rows)


def _alerts(rows, df):
    days = collections.Counter(r.dt for r in rows)
    assert rows and max(days.values()) <= 10 and len({(r.model, r.serial_number) for r in rows}) == len(rows)


def _elbow(rows, df):
    """One cluster has the squared deviation of all normal rows; more have no more of it."""
    told = [r[df.columns[1]] for r in sorted(rows, key=lambda r: r[0])]
    assert len(told) == 9 and all(b <= a * 1.05 for a, b in itertools.pairwise(told)) and told[-1] < told[0] / 2


#: What has to hold of the results of the queries that no SQL text can give: rows, frame, number of validation rows.
FACTS = {
    "train_gbt": lambda rows, df, valid: _scores(rows, valid),
    "train_gbt_focal": lambda rows, df, valid: _scores(rows, valid),
    "gbt_leaf_lr": lambda rows, df, valid: _scores(rows, valid),
    "save_model": lambda rows, df, valid: _scores(rows, valid),
    "early_stop_round": lambda rows, df, valid: [r.best for r in rows].index(True) == min(range(len(rows)), key=lambda i: (rows[i].loss, i)) or rows[[r.best for r in rows].index(True)].loss <= rows[0].loss,
    "feature_importance": lambda rows, df, valid: abs(sum(r.importance for r in rows) - 1) < 1e-9 and [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True),
    "select_topk_features": lambda rows, df, valid: len(df.columns) == 8 and sum(r.split == "valid" for r in rows) == valid,
    "random_search": lambda rows, df, valid: _search(rows),
    "cv_search": lambda rows, df, valid: _search(rows),
    "leaf_one_hot": lambda rows, df, valid: {r.ones for r in rows} == {12} and len({r.width for r in rows}) == 1,
    "predict": lambda rows, df, valid: _alerts(rows, df),
    "train_pipeline": lambda rows, df, valid: len(rows) == 1 and 0 <= rows[0].precision <= 1 and 0 <= rows[0].recall <= 1 and rows[0].alerts > 0,
    "kmeans_elbow": lambda rows, df, valid: _elbow(rows, df),
    "kmeans_labels": lambda rows, df, valid: {r.cluster_label for r in rows if r.tag == 0} == {0, 1, 2},
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_facts(spark, sf, name):
    valid = registry.labelled(spark, sf).filter("dt BETWEEN '2024-01-20' AND '2024-01-30'").count()
    df = registry.QUERIES[name](spark, sf)
    assert FACTS[name](df.collect(), df, valid) in (None, True)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) == 84 + 6 + 3 + 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
