"""Joint confidences, stable matchings, closures and estimates against plain versions."""

import random

import pytest

from rulespark.operators import align, estimates, metrics, predict, schema
from rulespark.operators.biases import path_pca_estimate
from rulespark.plans.terms import Atom, Rule, combine, parse_rule


def facts(seed, n=120):
    rng = random.Random(seed)
    names = [f"e{i}" for i in range(14)]
    return sorted({(rng.choice(names), rng.choice("pqrt"), rng.choice(names)) for _ in range(n)})


def test_joint_confidence_of_many_rules(spark):
    kb = spark.createDataFrame(facts(1), "s string, r string, o string")
    texts = [f"{a}(?x,?z) {b}({'?z,?y' if k else '?y,?z'}) => t(?x,?y)" for k, (a, b) in enumerate([(a, b) for a in "pqr" for b in "pqr"] * 2)]
    rules = [parse_rule(t) for t in dict.fromkeys(texts)] + [parse_rule("p(?x,?y) => t(?x,?y)"), parse_rule("q(?y,?x) => r(?x,?y)")]
    got = {tuple(r["rules"]): (r["support"], r["body_size"], r["pca_body_size"]) for r in predict.joint_counts(kb, rules).collect()}
    sets = {}
    for i, rule in enumerate(rules):
        for f in map(tuple, predict.body_facts(kb, rule).collect()):
            sets.setdefault(f, set()).add(i)
    wanted = {tuple(sorted(v)) for (s, _, o), v in sets.items() if s != o}
    assert got.keys() == wanted
    for key in random.Random(2).sample(sorted(wanted), 6):
        joint = combine([rules[i] for i in key])
        joint = Rule(joint.head, joint.body, counted=rules[key[0]].counted)
        want = metrics.support(kb, joint), metrics.body_size(kb, joint), metrics.pca_body_size(kb, joint)
        assert got[key] == want, key


def plain_matching(pairs):
    """Deferred acceptance, one offer at a time. ``pairs``: r1, r2, first, second."""
    wish = {a: [b for _, b in sorted((-f, b) for x, b, f, _ in pairs if x == a)] for a in {p[0] for p in pairs}}
    rank = {(a, b): (-s, a, b) for a, b, _, s in pairs}
    held, free = {}, sorted(wish)
    while free:
        a = free.pop()
        if wish[a]:
            b = wish[a].pop(0)
            if b not in held or rank[a, b] < rank[held[b], b]:
                if b in held:
                    free.append(held[b])
                held[b] = a
            else:
                free.append(a)
    return {(a, b) for b, a in held.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_stable_matching(spark, seed):
    rng = random.Random(seed)
    rows = [(f"a{i}", f"b{j}", rng.randint(0, 6) / 6, rng.randint(0, 6) / 6) for i in range(9) for j in range(8) if rng.random() < 0.6]
    pairs = spark.createDataFrame(rows, "r1 string, r2 string, confidence double, jaccard double")
    found = align.one_to_one(pairs, ["confidence"], ["jaccard"])
    got = {(r["r1"], r["r2"]) for r in found.collect()}
    assert got == plain_matching(rows)
    assert align.blocking_pairs(pairs, found, ["confidence"], ["jaccard"]).count() == 0
    some = pairs.filter("r1 = 'a0'").limit(1)
    assert align.blocking_pairs(pairs, some, ["confidence"], ["jaccard"]).count() > 0
    same = align.one_to_one(pairs)
    assert align.blocking_pairs(pairs, same).count() == 0
    assert align.one_to_one(pairs.limit(0)).count() == 0


def test_closure_of_a_long_chain(spark, monkeypatch):
    written = []
    keep = schema.stored
    monkeypatch.setattr(schema, "stored", lambda df, name: written.append(name) or keep(df, name))
    chain = spark.range(1000).selectExpr("id as a", "id + 1 as b")
    assert schema.transitive_closure(chain).count() == 1000 * 1001 // 2
    assert written.count("closure-new") <= 12


def test_closure_with_cycles(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(18)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    got = schema.transitive_closure(spark.createDataFrame(sorted(edges), "a long, b long"))
    assert {tuple(r) for r in got.collect()} == want
    assert schema.transitive_closure(got.limit(0)).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3])
def test_path_estimates(spark, length):
    rows = facts(4, 40)
    got = estimates.path_bodies(spark.createDataFrame(rows, "s string, r string, o string"), length)
    names = sorted({r for _, r, _ in rows})
    ends = {(r, c): {f[0 if c == "s" else 2] for f in rows if f[1] == r} for r in names for c in "so"}
    size = {r: sum(f[1] == r for f in rows) for r in names}
    stats = {r: (len(ends[r, "s"]) / size[r], len(ends[r, "o"]) / size[r], len(ends[r, "s"]), len(ends[r, "o"])) for r in names}
    common = lambda r1, c1, r2, c2: len(ends[r1, c1] & ends[r2, c2])
    seen = 0
    for row in got.collect():
        variables = ["?x", *[f"?z{i}" for i in range(1, length)], "?y"]
        body = []
        for k in range(length):
            label = row[f"l{k + 1}"]
            a, b = variables[k], variables[k + 1]
            body.append(Atom(a, label[:-1], b) if label[-1] == "+" else Atom(b, label[:-1], a))
        if length > 1 or body[0] != Atom("?x", row["h"], "?y"):
            want = path_pca_estimate(Rule(Atom("?x", row["h"], "?y"), tuple(body), support=7.0), stats, common)
            assert 7.0 / row["pairs"] == pytest.approx(want)
            seen += 1
    assert seen > 10


def plain_sets(rows, rules):
    """By nested loops: support, body size and PCA body size of each set of rules that derives some fact together."""
    derived = {}
    for i, rule in enumerate(rules):
        found = [{}]
        for a in rule.body:
            found = [{**b, a.s: s, a.o: o} for b in found for s, r, o in rows if r == a.r and None not in (s, o) and b.get(a.s, s) == s and b.get(a.o, o) == o and (a.s != a.o or s == o)]
        for b in found:
            derived.setdefault((b[rule.head.s], rule.head.r, b[rule.head.o]), set()).add(i)
    out = {}
    for key in {tuple(sorted(v)) for (s, _, o), v in derived.items() if s != o}:
        those = [f for f, v in derived.items() if set(key) <= v]
        side = rules[key[0]].counted
        known = {(f[side], f[1]) for f in rows}
        out[key] = sum(f in set(rows) for f in those), len(those), sum((f[side], f[1]) in known for f in those)
    return out


@pytest.mark.parametrize("counted", [0, 2])
def test_products_by_middle_are_counted_and_not_made(spark, counted, monkeypatch):
    """Rules whose ends have one middle each: alone, together, at known facts, and for entities that are both ends. No body is joined for them."""
    rng = random.Random(5)
    rows = [(f"e{i}", r, f"{r}{rng.randrange(3)}") for i in range(14) for r in "nm" if rng.random() < 0.8] + [f for f in facts(3, 60) if f[1] != "r"]
    kb = spark.createDataFrame(rows, "s string, r string, o string")
    texts = ["n(?x,?z) n(?y,?z)", "m(?x,?z) m(?y,?z)", "p(?x,?z) q(?z,?y)", "q(?y,?x)"]
    rules = [parse_rule(f"{t} => t(?x,?y)") for t in texts]
    rules = [Rule(r.head, r.body, counted=counted) for r in rules]
    followed = []
    inner = predict.packed
    monkeypatch.setattr(predict, "packed", lambda kb, body, x, y: followed.append({a.r for a in body}) or inner(kb, body, x, y))
    got = {tuple(r["rules"]): (r["support"], r["body_size"], r["pca_body_size"]) for r in predict.joint_counts(kb, rules).collect()}
    assert got == plain_sets(rows, rules) and (0, 1) in got and (0, 2) in got
    assert followed == [{"p", "q"}, {"q"}]
    several = rows + [("e1", "n", "n0"), ("e1", "n", "n1"), ("e1", "n", "n2")]  # one entity with more middles: the rule is followed as others are
    got = {tuple(r["rules"]): (r["support"], r["body_size"], r["pca_body_size"]) for r in predict.joint_counts(spark.createDataFrame(sorted(set(several)), kb.schema), rules).collect()}
    assert got == plain_sets(sorted(set(several)), rules)
