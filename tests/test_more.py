"""Further languages, inference and streams on small facts."""

import pytest

from rulespark.operators import biases, predict
from rulespark.operators.miner import Config, Miner, header, report_line
from rulespark.plans.terms import Atom, Rule, parse_rule
from rulespark.streaming.append import append_facts, fact_stream

FACTS = [(f"p{i}", "livesIn", f"c{i % 3}") for i in range(9)] + [(f"p{i}", "bornIn", f"c{i % 3}") for i in range(6)] + [(f"c{i}", "inLand", "l") for i in range(3)]
SCHEMA = [(f"p{i}", "rdf:type", "Person") for i in range(9)] + [(f"c{i}", "rdf:type", "City") for i in range(3)] + [("bornIn", "rdfs:domain", "Person"), ("bornIn", "rdfs:range", "City")]


@pytest.fixture(scope="module")
def kb(spark):
    return spark.createDataFrame(FACTS, "s string, r string, o string")


@pytest.fixture(scope="module")
def schema(spark):
    return spark.createDataFrame(SCHEMA, "s string, r string, o string")


RULE = Rule(Atom("?a", "bornIn", "?b"), (Atom("?a", "livesIn", "?b"),), 6, 6, 9, 6)


def test_signature_types_are_added_and_counted(kb, schema):
    (typed,) = biases.with_signature_types(kb, schema, [RULE])
    assert {a.r for a in typed.body} == {"livesIn", "rdf:type"} and (typed.support, typed.body_size, typed.pca_body_size) == (6, 9, 6)


def test_one_variable_counts_subjects(kb):
    found = {r.key: r for r in biases.mine_one_variable(kb, Config(max_atoms=2, min_head_size=3, min_head_coverage=0.5))}
    assert found[RULE.key].support == 6 and found[RULE.key].pca_body_size == 6


def test_open_rules(kb):
    found = biases.open_rules(kb, Config(max_atoms=2, min_head_size=3, min_head_coverage=0.5))
    lives = [r for r in found if r.head.r == "bornIn" and r.body[0].r == "livesIn"]
    assert lives and lives[0].support == 6 and lives[0].body_size == 9


def test_completeness(spark, kb, schema):
    truth = spark.createDataFrame([(f"p{i}", "bornIn", i < 6) for i in range(9)], "e string, r string, complete boolean")
    got = {(r["head"], r["body"]): (r["support"], r["against"]) for r in biases.completeness_rules(kb, truth, schema, 1).collect()}
    assert got["isComplete", "hasNumberOfValuesGreaterThan0"] == (6, 0) and got["isIncomplete", "hasNumberOfValuesSmallerThan1"] == (3, 0) and got["isComplete", "type Person"] == (6, 3)


def test_predictions_and_inference(spark, kb):
    rule = parse_rule("livesIn(?a,?b) => bornIn(?a,?b)")
    assert predict.predictions(kb, rule).count() == 3 and predict.assumed_false(kb, rule).count() == 0
    known = predict.iterate(kb, lambda facts: [RULE], 0.9, 3)
    assert known.filter("iteration = 1").count() == 3 and known.count() == len(FACTS) + 3
    assert predict.joint_confidence(kb, [rule, parse_rule("livesIn(?a,?b) inLand(?b,?c) => bornIn(?a,?b)")])[0, 1] == 1.0
    scored = predict.all_predictions(kb, [rule]).selectExpr("s", "r", "o", "0.95D as score")
    assert predict.bucket_sample(scored, 2).count() == 2


def test_report(kb):
    rules = Miner(kb, Config(max_atoms=2, min_head_size=3, min_head_coverage=0.5)).mine()
    lines = [report_line(r) for r in rules]
    assert all(len(x.split("\t")) == len(header().split("\t")) for x in lines)
    assert "?a  livesIn  ?b   => ?a  bornIn  ?b\t1\t0.666666667\t1\t6\t9\t6\t?a" in lines


def test_stream_adds_what_is_new(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.tsv").write_text("a\tr\tb\na\tr\tb\n")
    for n in (1, 2):
        query = append_facts(fact_stream(spark, str(tmp_path / "in")), str(tmp_path / "kb"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        (tmp_path / "in" / "2.tsv").write_text("a\tr\tb\nid\tc\tr\td\n")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "kb")).select("s", "r", "o").collect()} == {("a", "r", "b"), ("c", "r", "d")}


@pytest.mark.parametrize("first", ["02", "8", "g"])
def test_bucket_samples_are_the_least_hashes(spark, first):
    """Whether the facts of low hash are enough for a bucket or not; and they are not ordered whole."""
    import hashlib

    rows = [(f"s{i}", "p", f"o{i}", round((i % 7) / 10 + 0.05, 2)) for i in range(400)] + [("only", "p", "one", 0.95)]
    got = predict.bucket_sample(spark.createDataFrame(rows, "s string, r string, o string, score double"), 5, first=first)
    by = {}
    for s, r, o, score in rows:
        by.setdefault(9 - int(score * 10 + 1e-9), []).append((hashlib.md5(f"\t{s}\t{r}\t{o}".encode()).hexdigest(), s))
    assert sorted((x["bucket"], x["s"]) for x in got.collect()) == sorted((b, s) for b, own in by.items() for _, s in sorted(own)[:5])


def test_joint_predictions_from_rules(spark, kb):
    """As from the rules' facts one by one."""
    rules = [parse_rule("livesIn(?x,?y) => bornIn(?x,?y)"), parse_rule("livesIn(?a,?b) inLand(?b,?c) => bornIn(?a,?b)"), parse_rule("bornIn(?x,?y) => livesIn(?x,?y)")]
    weights = [0.3, 0.9, 0.8]
    one = predict.joint_predictions(predict.all_predictions(kb, rules, True), spark.createDataFrame(list(enumerate(weights)), "rule int, confidence double"))
    got = predict.joint_from_rules(kb, rules, weights)
    plain = lambda df: sorted((r["s"], r["r"], r["o"], tuple(r["rules"]), round(r["naive"], 12)) for r in df.collect())
    assert plain(got) == plain(one) != []
    assert "collect_list(rule" not in got._jdf.queryExecution().optimizedPlan().toString()
