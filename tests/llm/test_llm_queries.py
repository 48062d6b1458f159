"""The queries with SQL against DuckDB, and learned queries on their held-out rows, over a given table."""

import duckdb
import pandas as pd
import pytest

from maskwright.llm import queries

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def table(name, sf_dir):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/{name}.parquet'").df()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, oracle_db, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = oracle_db.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_language_of_held_out_rows(spark):
    out = queries.op1_language_id(spark, LARGE).toPandas().merge(table("documents", LARGE), on="doc_id")
    held = out[out.held_out & out.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert out.score.between(0, 1).all()
    assert out.rejected.mean() < 0.002


def test_toxicity_of_held_out_rows(spark):
    out = queries.op3_toxicity(spark, LARGE).toPandas().merge(table("labels", LARGE), on="doc_id")
    held = out[out.held_out]
    hits = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hits / held.toxic.sum() > 0.85
    assert hits / held.predicted.sum() > 0.85
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_quality_draws_good_rows(spark):
    out = queries.op7_importance_resampling(spark, LARGE).toPandas()
    assert out.selected.sum() == round(0.8 * len(out))
    held = out[out.held_out].merge(table("labels", LARGE), on="doc_id")
    assert held[held.quality == 1].selected.mean() > held[held.quality == 0].selected.mean() + 0.3


def test_language_model(spark):
    import re
    from collections import Counter
    from math import log10

    out = queries.op6_context_mixing(spark, SMALL).toPandas().set_index("doc_id")
    docs = table("documents", SMALL)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), None] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    counts = Counter(t for d in tokens if not out.held_out[d] for t in tokens[d])
    n, v = sum(counts.values()), len(counts)
    for d, words in tokens.items():
        base = sum(log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert abs(base - out.base_score[d]) < 1e-6 * abs(base)
        assert (out.n_tokens[d], out.n_known[d], out.train_tokens[d]) == (len(words), sum(counts[w] > 0 for w in words), n)
    assert (out.score < 0).all()
    assert out.bits_per_byte.mean() < 4.2
