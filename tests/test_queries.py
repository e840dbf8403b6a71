"""Registered queries against their SQL on the smallest tables; the driver compares all of them on larger ones."""

from pathlib import Path

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["kb_size", "overlap_so", "cumulative_histogram", "not_exists_relation_variable", "cardinality_lt", "difference_3var", "rule_metrics", "mine_2atom_rules", "rule_hits", "type_closure", "kb_delta", "align_equivalences"]
CHOSEN += ["mine_closed_rules_skyline", "triangle_supports", "mine_one_variable", "mine_constants", "tsv_facts", "ntriples_renamed", "stream_append", "completeness_rules", "joint_confidence", "lifted_types", "evaluation_verdicts", "typed_heads", "index_load"]

CHOSEN += ["iterated_inference", "conditional_minimal_keys", "path_bodies_5atoms", "joint_rules_20", "one_to_one_alignment", "square_supports"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def comparable(rows, columns):
    def one(v):
        if isinstance(v, float):
            return round(v, 9)
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(one(r[i]) for i in order)) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = comparable([tuple(r) for r in df.collect()], df.columns)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert got == comparable(want.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
