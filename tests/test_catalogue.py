"""Registered queries give the rows of their SQL twins on the smallest tables."""

import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
SAMPLE = ["v5_vector_topk", "g6_snowball", "d4_sections", "d9_fused_results", "f19_f20_pruned_citations", "k2_upsert", "t1_debounced", "j11_duplicate_detection",
          "d9_fused_each", "d10_judged_each", "t5_output_between_tags", "s7_page_tree", "p11_dual_threshold"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, name):
    import collections

    import duckdb

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
    from compare import TABLES, plain

    from folioflow import catalogue

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert collections.Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want


def test_every_sql_has_a_query():
    from folioflow import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10 and "v5_vector_topk" in __spark_entry__.queries()
