"""Rule texts, rule algebra and reports on typed-in rules, and their stated results: what readers, parsers and editors of rules give, held against SQL values."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespark.functions import text
from rulespark.operators import align, miner, predict
from rulespark.plans import terms
from rulespark.plans.more_queries import _rows, _written
from rulespark.plans.terms import Atom, Rule, parse_rule
from rulespark.sources import readers

EXAMPLES = {}


def register(name, sql):
    def keep(fn):
        EXAMPLES[name] = fn, sql
        return fn

    return keep


@register("rules_file", "SELECT * FROM (VALUES ('?a  b  ?c  ?c  a  ?b   => ?a  h  ?b', 1), ('?a  q  ?b   => ?b  p  ?a', 2), ('?b  r  ?a   => ?a  h  x', 3)) t(rule, n)")
def _rules_file(spark: SparkSession, d: str) -> DataFrame:
    lines = _rows(spark, [("?x  b  ?z  ?z  a  ?y   => ?x  h  ?y\t0.5\t1",), ("?k  q  ?m   => ?m  p  ?k",), ("?z  r  ?y   => ?y  h  x",), ("?x  only  ?y",), ("",)], "value string").coalesce(1)
    found = readers.read_rules(spark, _written(spark, "rules", lines))
    texts = {terms.native_text(r): r for r in found}
    want = ["?a  b  ?c  ?c  a  ?b   => ?a  h  ?b", "?a  q  ?b   => ?b  p  ?a", "?b  r  ?a   => ?a  h  x"]
    keys = {parse_rule(w).key: w for w in want}
    return _rows(spark, [(keys.get(r.key, t), 1 + want.index(keys[r.key]) if r.key in keys else 0) for t, r in texts.items()], "rule string, n int")


@register("clauses_file", "SELECT * FROM (VALUES ('b(?a,?b) => h(?a,?b)', 0.8::DOUBLE), ('p(?a,?c) q(?c,?b) => h(?a,?b)', NULL)) t(rule, score)")
def _clauses(spark: SparkSession, d: str) -> DataFrame:
    lines = _rows(spark, [("[Rule 1] [Pos cover = 4 confidence = 0.8]",), ("h(A,B) :- b(A,B).",), ("h(A,B) :- p(A,C), q(C,B).",), ("",)], "value string").coalesce(1)
    found = readers.read_clauses(spark, _written(spark, "clauses", lines))
    return _rows(spark, [(terms.datalog_text(r), s) for r, s in found], "rule string, score double")


@register("cardinality_names", "SELECT * FROM (VALUES ('hasNumberOfValuesEquals3', 'Equals', false, 3), ('<hasNumberOfValuesGreaterThanInv20>', 'GreaterThan', true, 20), ('hasNumberOfValuesSmallerThan1', 'SmallerThan', false, 1), ('hasNumberOfValues3', NULL, NULL, NULL), ('bought', NULL, NULL, NULL)) t(name, kind, inverse, n)")
def _cardinality_names(spark: SparkSession, d: str) -> DataFrame:
    names = ["hasNumberOfValuesEquals3", "<hasNumberOfValuesGreaterThanInv20>", "hasNumberOfValuesSmallerThan1", "hasNumberOfValues3", "bought"]
    found = [(n, terms.cardinality(n)) for n in names]
    return _rows(spark, [(n, c and c.kind, c and c.inverse, c and c.n) for n, c in found], "name string, kind string, inverse boolean, n int")


@register("atom_variables", "SELECT * FROM (VALUES ('?x r ?y', 2, '?x,?y', 0, 2, false, false), ('a r ?y', 1, '?y', -1, 2, false, false), ('?x ?r ?x', 3, '?x,?r', 0, -1, false, true), ('a r b', 0, '', -1, -1, true, false)) t(atom, n, variables, x_at, y_at, ground, reflexive)")
def _atom_variables(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t, Atom(*t.split())) for t in ("?x r ?y", "a r ?y", "?x ?r ?x", "a r b")]
    return _rows(spark, [(t, terms.number_of_variables(a), ",".join(a.variables), a.position("?x"), a.position("?y"), terms.ground(a), terms.reflexive(a)) for t, a in rows], "atom string, n int, variables string, x_at int, y_at int, ground boolean, reflexive boolean")


@register("joined_atoms", "SELECT * FROM (VALUES ('?x r ?y', '?y q ?z', '?y', '2-0', true), ('?x r ?y', '?x q ?y', '?x,?y', '0-0,2-2', true), ('?x r ?y', '?v q ?z', '', '', false)) t(a, b, common, places, connected)")
def _joined_atoms(spark: SparkSession, d: str) -> DataFrame:
    rows = [("?x r ?y", "?y q ?z"), ("?x r ?y", "?x q ?y"), ("?x r ?y", "?v q ?z")]
    made = [(a, b, Atom(*a.split()), Atom(*b.split())) for a, b in rows]
    return _rows(spark, [(a, b, ",".join(terms.variables_in_common(x, y)), ",".join(f"{i}-{j}" for i, j in terms.join_positions(x, y)), terms.connected(x, y)) for a, b, x, y in made], "a string, b string, common string, places string, connected boolean")


_TEXTS = ("livesIn(?a,?b) marriedTo(?a,?c) => livesIn(?c,?b)", "?x  <r>  ?y  ?y  <q>  <c>   => ?x  <h>  ?y", "h(?x,?y) :- b(?y,?z), a(?z,?x)", "alone(?x,?y)")


@register("parsed_rules", """SELECT * FROM (VALUES (1, '?a  livesIn  ?b  ?a  marriedTo  ?c   => ?c  livesIn  ?b', 'livesIn(?a,?b) marriedTo(?a,?c) => livesIn(?c,?b)'), (2, '?y  <q>  <c>  ?x  <r>  ?y   => ?x  <h>  ?y', 'q(?y,<c>) r(?x,?y) => h(?x,?y)'),
  (3, '?z  a  ?x  ?y  b  ?z   => ?x  h  ?y', 'a(?z,?x) b(?y,?z) => h(?x,?y)'), (4, NULL, NULL)) t(n, native, datalog)""")
def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """Both notations, bodies in their printed order."""
    rules = [parse_rule(t) for t in _TEXTS]
    return _rows(spark, [(i, r and terms.native_text(r), r and terms.datalog_text(r)) for i, r in enumerate(rules, 1)], "n int, native string, datalog string")


@register("raw_rule_texts", "SELECT * FROM (VALUES ('?y  b  ?z  ?z  a  ?x   => ?x  h  ?y', '?a  b  ?b  ?b  a  ?c   => ?c  h  ?a', '?a,?b,?c')) t(raw, renamed, fresh)")
def _raw(spark: SparkSession, d: str) -> DataFrame:
    from itertools import islice

    r = parse_rule(_TEXTS[2])
    return _rows(spark, [(terms.native_text(r, ordered=False), terms.native_text(terms.normalise(r), ordered=False), ",".join(islice(terms.fresh_variables(), 3)))], "raw string, renamed string, fresh string")


@register("rule_reports", """SELECT * FROM (VALUES (1, 'Rule' || chr(9) || 'Head Coverage' || chr(9) || 'Std Confidence' || chr(9) || 'PCA Confidence' || chr(9) || 'Positive Examples' || chr(9) || 'Body size' || chr(9) || 'PCA Body size' || chr(9) || 'Functional variable'),
  (2, 'b(?x,?y) => h(?x,?y)' || chr(9) || '0.5' || chr(9) || '0.333333333' || chr(9) || '0.666666667' || chr(9) || '2' || chr(9) || '6' || chr(9) || '3' || chr(9) || '?x'),
  (3, '?x  b  ?y   => ?x  h  ?y' || chr(9) || '0.5' || chr(9) || '0.666666667' || chr(9) || '2' || chr(9) || '3' || chr(9) || '?x')) t(n, line)""")
def _reports(spark: SparkSession, d: str) -> DataFrame:
    r = Rule(Atom("?x", "h", "?y"), (Atom("?x", "b", "?y"),), 2, 4, 6, 3)
    return _rows(spark, [(1, miner.header()), (2, miner.report_line(r, datalog=True)), (3, miner.report_line(r, std=False))], "n int, line string")


@register("rule_properties", """SELECT * FROM (VALUES ('b(?x,?y) => h(?x,?y)', true, 2, '', true), ('b(?x,?z) => h(?x,?y)', false, 2, '?y,?z', false), ('a(?x,?z) b(?z,?y) => h(?x,?y)', true, 3, '', true), ('a(?x,?z) b(?x,?z) => h(?x,?y)', false, 3, '?y', false), ('a(?x,?x) => h(?x,?y)', false, 2, '?y', false)) t(rule, closed, atoms, open, path)""")
def _properties(spark: SparkSession, d: str) -> DataFrame:
    texts = ("b(?x,?y) => h(?x,?y)", "b(?x,?z) => h(?x,?y)", "a(?x,?z) b(?z,?y) => h(?x,?y)", "a(?x,?z) b(?x,?z) => h(?x,?y)", "a(?x,?x) => h(?x,?y)")
    return _rows(spark, [(t, r.closed, r.real_length, ",".join(sorted(r.open_variables)), terms.single_path(r)) for t in texts for r in [parse_rule(t)]], "rule string, closed boolean, atoms int, open string, path boolean")


@register("redundant_rules", """SELECT * FROM (VALUES ('h(?y,?x) b(?x,?y) => h(?x,?y)', false, false, 3), ('b(?x,?z) b(?y,?z) => h(?x,?y)', false, false, 3), ('h(?x,?z) b(?z,?w) b(?w,?y) => h(?x,?y)', true, false, 4), ('b(?x,?z) b(?x,?w) => h(?x,?z)', false, false, 2), ('h(?x,?z) b(?y,?w) b(?z,?w) => h(?x,?y)', true, true, 4)) t(rule, level2, diamond, left_over)""")
def _redundant(spark: SparkSession, d: str) -> DataFrame:
    """Level-2 redundancy, diamonds, and how many atoms are left once those that say nothing are dropped."""
    texts = ("h(?y,?x) b(?x,?y) => h(?x,?y)", "b(?x,?z) b(?y,?z) => h(?x,?y)", "h(?x,?z) b(?z,?w) b(?w,?y) => h(?x,?y)", "b(?x,?z) b(?x,?w) => h(?x,?z)", "h(?x,?z) b(?y,?w) b(?z,?w) => h(?x,?y)")
    return _rows(spark, [(t, terms.redundant_subgraph(r), terms.disallowed_diamond(r.atoms), len(terms.without_redundant(r.atoms, r.head.variables))) for t in texts for r in [parse_rule(t)]], "rule string, level2 boolean, diamond boolean, left_over int")


@register("equivalent_rules", "SELECT * FROM (VALUES ('a(?x,?z) b(?z,?y) => h(?x,?y)', 'b(?w,?q) a(?p,?w) => h(?p,?q)', true, false), ('a(?x,?z) b(?z,?y) => h(?x,?y)', 'a(?x,?z) b(?y,?z) => h(?x,?y)', false, false), ('a(?x,?y) => h(?x,?y)', 'b(?x,?y) a(?x,?y) => h(?x,?y)', false, true)) t(a, b, same, subsumes)")
def _equivalent(spark: SparkSession, d: str) -> DataFrame:
    texts = (("a(?x,?z) b(?z,?y) => h(?x,?y)", "b(?w,?q) a(?p,?w) => h(?p,?q)"), ("a(?x,?z) b(?z,?y) => h(?x,?y)", "a(?x,?z) b(?y,?z) => h(?x,?y)"), ("a(?x,?y) => h(?x,?y)", "b(?x,?y) a(?x,?y) => h(?x,?y)"))
    return _rows(spark, [(a, b, terms.equivalent(p.atoms, q.atoms), terms.subsumes(p, q)) for a, b in texts for p, q in [(parse_rule(a), parse_rule(b))]], "a string, b string, same boolean, subsumes boolean")


@register("edited_rules", "SELECT * FROM (VALUES ('added', 'b(?x,?y) c(?y,?a) => h(?x,?y)'), ('bound', 'b(one,?y) => h(one,?y)'), ('combined', 'b(?x,?y) q(?x,?v0) => h(?x,?y)'), ('pca', 'b(?x,?y) h(?x,?a)'), ('replaced', 'd(?x,?y) => h(?x,?y)')) t(edit, rule)")
def _edited(spark: SparkSession, d: str) -> DataFrame:
    r = parse_rule("b(?x,?y) => h(?x,?y)")
    show = lambda atoms: " ".join(f"{a.r}({a.s},{a.o})" for a in atoms)
    pca = [a.replace({"?x1": "?a"}) for a in terms.pca_query(r)]
    joint = terms.combine([r, parse_rule("q(?p,?z) => h(?p,?w)")])
    return _rows(spark, [("added", terms.datalog_text(r.add(Atom("?y", "c", r.fresh())))), ("bound", terms.datalog_text(r.bind("?x", "one"))), ("replaced", terms.datalog_text(r.replace_last(Atom("?x", "d", "?y")))), ("combined", terms.datalog_text(joint)), ("pca", show(pca))], "edit string, rule string")


@register("rule_difference", "SELECT * FROM (VALUES ('b(?x,?y) => h(?x,?y)')) t(rule)")
def _rule_difference(spark: SparkSession, d: str) -> DataFrame:
    a = [parse_rule(t) for t in ("b(?x,?y) => h(?x,?y)", "a(?x,?z) b(?z,?y) => h(?x,?y)")]
    b = [parse_rule("b(?w,?q) a(?p,?w) => h(?p,?q)")]
    return _rows(spark, [(terms.datalog_text(r),) for r in terms.rule_difference(a, b)], "rule string")


@register("chosen_rules", "SELECT * FROM (VALUES ('a(?x,?z) b(?z,?y) => <db:h>(?x,?y)', true, true, false, true), ('a(?x,one) => <db:h>(?x,two)', true, false, true, false), ('a(?x,?y) => h(?x,?y)', false, false, false, false)) t(rule, crosses, triangle, values_, two_hops)")
def _chosen(spark: SparkSession, d: str) -> DataFrame:
    texts = ("a(?x,?z) b(?z,?y) => <db:h>(?x,?y)", "a(?x,one) => <db:h>(?x,two)", "a(?x,?y) => h(?x,?y)")
    return _rows(spark, [(t, align.crosses(r), align.is_triangle(r), align.translates_values(r), align.is_two_hops(r)) for t in texts for r in [parse_rule(t)]], "rule string, crosses boolean, triangle boolean, values_ boolean, two_hops boolean")


@register("date_literals", "SELECT * FROM (VALUES ('3 May 1970', '1970-05-03'), ('May 1970', '1970-05-##'), ('1970', '1970-##-##'), ('soon', NULL)) t(said, literal)")
def _dates(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [("3 May 1970",), ("May 1970",), ("1970",), ("soon",)], "said string").select("said", text.date_literal(F.col("said")).alias("literal"))


@register("decimal_texts", "SELECT * FROM (VALUES (0.1::DOUBLE, '0.1'), (2.0::DOUBLE, '2'), (0.3333333333333333::DOUBLE, '0.333333333'), (0.0::DOUBLE, '0'), (0.0000000005::DOUBLE, '0')) t(x, written)")
def _decimals(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(x, text.decimal(x)) for x in (0.1, 2.0, 1 / 3, 0.0, 5e-10)], "x double, written string")


@register("joined_reports", "SELECT * FROM (VALUES ('x  b  y', 1, 10), ('p  q  r', 2, NULL)) t(rule, n, n_2)")
def _joined_reports(spark: SparkSession, d: str) -> DataFrame:
    a, b = _rows(spark, [("x  b  y", 1), ("p  q  r", 2)], "rule string, n int"), _rows(spark, [("x  b  y", 10), ("else", 20)], "rule string, n int")
    return predict.join_rules(a, b, "left")


@register("ranked_rules", "SELECT * FROM (VALUES ('b', 0.5::DOUBLE, 7, 1), ('c', 0.5::DOUBLE, 9, 2), ('a', 0.9::DOUBLE, 1, 3)) t(rule, pca_confidence, support, rank)")
def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return predict.rank_rules(_rows(spark, [("a", 0.9, 1), ("b", 0.5, 7), ("c", 0.5, 9)], "rule string, pca_confidence double, support int"))


@register("confidence_gain", "SELECT * FROM (VALUES ('b(?x,?y) => h(?x,?y)', 0.3::DOUBLE)) t(general, gain)")
def _gain(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    special = replace(parse_rule("b(?x,?y) <linksTo>(?x,?y) => h(?x,?y)"), support=8.0, pca_body_size=10)
    general = replace(parse_rule("b(?x,?y) => h(?x,?y)"), support=5.0, pca_body_size=10)
    found = predict.confidence_gain([special], [general])
    return _rows(spark, [(terms.datalog_text(parse_rule(g)), round(x, 9)) for _, g, x in found], "general string, gain double")


@register("legacy_evaluations", "SELECT * FROM (VALUES ('?x  b  ?y   => ?x  h  ?y', 'a', 'h', 'c', 'True'), ('?x  b  ?y   => ?x  h  ?y', 'd', 'h', 'e', 'False'), ('?x  b  ?y   => ?x  h  ?y', 'f', 'h', 'g', 'Unknown')) t(rule, s, r, o, verdict)")
def _legacy(spark: SparkSession, d: str) -> DataFrame:
    lines = ["Y\tlost/h/fact", "?x  b  ?y  ?x  h  ?y\tKey variable: ?x", "Y\ta/h/c", "N\td/h/e", "?\tf/h/g", "Y\tnot a fact"]
    return _rows(spark, predict.legacy_evaluations(lines), "rule string, s string, r string, o string, verdict string")


@pytest.mark.parametrize("name", EXAMPLES)
def test_stated_results(spark, name):
    fn, sql = EXAMPLES[name]
    found = fn(spark, "")
    want = duckdb.sql(sql)
    order = [want.columns.index(c) for c in found.columns]
    assert sorted(want.columns) == sorted(found.columns)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
