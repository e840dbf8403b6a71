"""Queries on a twelve-fact knowledge base, and readers."""

import pytest

from rulespark.operators import setops, stats
from rulespark.operators.metrics import rule_metrics
from rulespark.plans.bgp import compile_query, contains, count, exists
from rulespark.plans.terms import Atom, parse_rule
from rulespark.sources import readers

FACTS = [
    ("Luis", "wasBornIn", "Guayaquil"), ("Oana", "livesIn", "Paris"), ("Ambar", "worksAt", "ESPOL"), ("Thomas", "wasBornIn", "Munich"), ("Luis", "livesIn", "Paris"), ("Luis", "worksAt", "Telecom"),
    ("Antoine", "wasBornIn", "Colmar"), ("Thomas", "livesIn", "Paris"), ("Thomas", "worksAt", "Telecom"), ("Telecom", "isLocatedIn", "Paris"), ("Antoine", "livesIn", "Paris"), ("Antoine", "worksAt", "Telecom"),
]


@pytest.fixture(scope="module")
def kb(spark):
    return spark.createDataFrame(FACTS, "s string, r string, o string")


def values(df):
    return {tuple(r) if len(r) > 1 else r[0] for r in df.collect()}


def test_negated_existence(kb):
    assert count(kb, Atom("hasChild", "~exists", "?x")) == 6 and count(kb, Atom("hasChild", "~existsInv", "?x")) == 6
    assert not contains(kb, Atom("wasBornIn", "~exists", "Antoine")) and contains(kb, Atom("wasBornIn", "~exists", "Ambar"))
    assert contains(kb, Atom("wasBornIn", "~existsInv", "Paris")) and contains(kb, Atom("locatedIn", "~existsInv", "Cuenca"))
    assert values(compile_query(kb, [Atom("worksAt", "~exists", "?x")], ["?x"])) == {"Oana", "Telecom"}
    assert values(compile_query(kb, [Atom("?x", "~exists", "Luis")], ["?x"])) == {"isLocatedIn"}


def test_negated_existence_with_types(spark, kb):
    more = kb.union(spark.createDataFrame([(c, "rdf:type", "City") for c in ("Guayaquil", "Munich", "Colmar", "Paris")] + [(p, "rdf:type", "Person") for p in ("Luis", "Thomas", "Antoine", "Oana", "Ambar")], kb.schema))
    assert values(compile_query(more, [Atom("wasBornIn", "~existsInv", "?x"), Atom("?x", "rdf:type", "City")], ["?x"])) == {"Paris"}
    assert ("wasBornIn", "Ambar") in values(compile_query(more, [Atom("?x", "~exists", "?y"), Atom("?y", "rdf:type", "Person")], ["?x", "?y"]))
    assert ("wasBornIn", "Paris") in values(compile_query(more, [Atom("?x", "~existsInv", "?y"), Atom("?y", "rdf:type", "City")], ["?x", "?y"]))


def test_joins_and_filters(kb):
    assert exists(kb, [Atom("?x", "worksAt", "?y"), Atom("?y", "isLocatedIn", "Paris")]) and not exists(kb, [Atom("?x", "worksAt", "Paris")]) and not exists(kb, [])
    pairs = compile_query(kb, [Atom("?x", "livesIn", "?z"), Atom("?y", "livesIn", "?z"), Atom("?x", "differentFrom", "?y")], ["?x", "?y"])
    assert pairs.count() == 12
    assert values(compile_query(kb, [Atom("?x", "hasNumberOfValuesEquals0", "worksAt")], ["?x"])) == {"Oana", "Telecom"}
    with pytest.raises(ValueError):
        compile_query(kb, [Atom("?x", "livesIn", "?y")], ["?q"])


def test_statistics_and_rule(kb):
    got = {r["r"]: (r["functionality"], r["inverse_functionality"]) for r in stats.summary(kb).collect()}
    assert got == {"wasBornIn": (1, 1), "livesIn": (1, 0.25), "worksAt": (1, 0.5), "isLocatedIn": (1, 1)}
    row = rule_metrics(kb, parse_rule("worksAt(?x,?z) isLocatedIn(?z,?y) => livesIn(?x,?y)")).head()
    assert (row["support"], row["body_size"], row["pca_body_size"], row["head_coverage"]) == (3, 3, 3, 0.75)
    assert setops.materialise_inverses(kb).count() == 12


def test_readers(spark, tmp_path):
    (tmp_path / "facts.tsv").write_text('<a>\t<r>\t"12"^^xsd:integer\n<a>\t<r>\t"12"^^xsd:integer\nid\t <b> \t<r>\t"x"@en\n<a>\t<r>\nq\tw\te\tr\tt\ty\n<Arakan_1942–43>\t<r>\t<c> .\n', encoding="utf-8")
    got = values(readers.read_facts(spark, str(tmp_path / "facts.tsv")))
    assert got == {("<a>", "<r>", '"12"'), ("<b>", "<r>", '"x"@en'), ("<Arakan_1942–43>", "<r>", "<c>")}
    (tmp_path / "p.tsv").write_text("1\ta\tr\tb\t0.25\n2\ta\tr\tb\t0.5\n3\tc\tr\td\tx\n")
    assert values(readers.read_probabilistic(spark, str(tmp_path / "p.tsv"))) == {("a", "r", "b", 0.5), ("c", "r", "d", 1.0)}
    (tmp_path / "s.nt").write_text('<a> <r> <b> .\n<a> <r> "x y" .\n')
    assert readers.read_spaced(spark, str(tmp_path / "s.nt")).count() == 2 == readers.read_ntriples(spark, str(tmp_path / "s.nt")).count()
    (tmp_path / "rules").write_text("?a  <r>  ?b   => ?a  <h>  ?b\t0.5\nnone\n")
    assert len(readers.read_rules(spark, str(tmp_path / "rules"))) == 1
