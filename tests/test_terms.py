from rulespark.functions.text import decimal
from rulespark.operators.align import crosses, is_triangle, translates_values
from rulespark.plans.terms import Atom, Rule, canonical_path, cardinality, combine, datalog_text, disallowed_diamond, equivalent, fresh_variables, native_text, normalise, parse_atoms, parse_rule, pca_query, redundant_subgraph, subsumes


def q(text):
    return [Atom(f"?{x[-2]}", x[:-2], f"?{x[-1]}") for x in text.split()]


def test_parsers():
    datalog = parse_rule("livesIn(?x,?y) bornIn(?x,?z) => diedIn(?x,?y)")
    native = parse_rule("?x  <livesIn>  ?y  ?x  <bornIn>  ?z   => ?x  <diedIn>  ?y")
    assert datalog.head == Atom("?x", "diedIn", "?y") and len(datalog.body) == 2
    assert native.head == Atom("?x", "<diedIn>", "?y") and native.body[1] == Atom("?x", "<bornIn>", "?z")
    assert parse_rule("diedIn(?x,?y) :- livesIn(?x,?y)").head.r == "diedIn"
    assert parse_rule("nothing here") is None
    assert parse_atoms("r(?a,?b)") == [Atom("?a", "r", "?b")]
    assert normalise(datalog).head.s == "?a"
    assert cardinality("hasNumberOfValuesEqualsInv3").inverse and cardinality("other") is None


def test_closed_and_open():
    rule = parse_rule("r(?x,?z) r(?z,?y) => h(?x,?y)")
    assert rule.closed and not parse_rule("r(?x,?z) => h(?x,?y)").closed
    assert set(parse_rule("r(?x,?z) => h(?x,?y)").open_variables) == {"?z", "?y"}
    assert [a.r for a in canonical_path(parse_rule("b(?z,?y) a(?x,?z) => h(?x,?y)"))] == ["a", "b"]


def test_equivalence():
    assert equivalent(q("hab rac scb"), q("hxy rxz szy"))
    assert equivalent(q("hab rac scb"), q("hab scb rac"))
    assert not equivalent(q("hab rac scb"), q("rac hab scb"))  # another head
    assert not equivalent(q("hab rac scb"), q("hab rca scb"))  # another direction
    assert not equivalent([Atom("?a", "h", "X"), Atom("?a", "r", "Y")], [Atom("?a", "h", "Y"), Atom("?a", "r", "X")])


def test_diamonds():
    r = lambda t: q(t)
    assert disallowed_diamond(r("rab sab sae rae saf raf"))
    assert disallowed_diamond(r("rax sam sax ram"))
    assert not disallowed_diamond(r("rax sam txm"))
    assert not disallowed_diamond(r("rab sab sae rae saf taf"))
    assert disallowed_diamond(r("rab sac rdb sdc"))
    assert disallowed_diamond(r("rab rax sba sxa"))
    assert not disallowed_diamond(r("rab rax sba sax"))
    assert not disallowed_diamond(r("rab sbx rxc sca"))
    assert not redundant_subgraph(Rule(*(lambda x: (x[0], tuple(x[1:])))(r("hab rax sxb"))))


def test_algebra_and_text():
    small, large = parse_rule("r(?x,?y) => h(?x,?y)"), parse_rule("r(?a,?b) s(?a,?c) => h(?a,?b)")
    assert subsumes(small, large) and not subsumes(large, small)
    joint = combine([small, parse_rule("s(?x,?z) t(?z,?y) => h(?x,?y)")])
    assert len(joint.body) == 3 and joint.closed
    assert pca_query(small)[-1].o not in ("?x", "?y") or pca_query(small)[-1].s == "?x"
    assert native_text(small) == "?x  r  ?y   => ?x  h  ?y"
    assert datalog_text(parse_rule("<r>(?x,?y) => <h>(?x,?y)")) == "r(?x,?y) => h(?x,?y)"
    assert [v for v, _ in zip(fresh_variables(), range(28))][-2:] == ["?a1", "?b1"]
    assert decimal(0.5) == "0.5" and decimal(1 / 3) == "0.333333333" and decimal(2.0) == "2" and decimal(0.125, 2) == "0.12"
    assert is_triangle(parse_rule("r(?x,?z) s(?z,?y) => h(?x,?y)")) and crosses(parse_rule("<db:r>(?x,?y) => <h>(?x,?y)"))
    assert translates_values(Rule(Atom("?a", "h", "X"), (Atom("?a", "r", "Y"),)))
