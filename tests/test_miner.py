"""The miner against nested loops over small random knowledge bases."""

import math
import random
from collections import Counter
from itertools import combinations, permutations, product

import pytest

from rulespark.operators.metrics import batch_supports, body_size, pca_body_size, support
from rulespark.operators.metrics import path_bounds, path_body_sizes, triangle_counts
from rulespark.operators.miner import Config, Miner, bias_class, lossy_vanilla
from rulespark.plans.terms import Atom, Rule, parse_rule, without_redundant


def bindings(facts, atoms, env=None):
    env = env or {}
    if not atoms:
        yield env
        return
    a, *rest = atoms
    for s, r, o in facts:
        if r != a.r:
            continue
        new = dict(env)
        if all((new.setdefault(t, v) == v) if t.startswith("?") else t == v for t, v in ((a.s, s), (a.o, o))):
            yield from bindings(facts, rest, new)


def pairs(facts, atoms, variables):
    return {tuple(e[v] for v in variables) for e in bindings(facts, list(atoms))}


# The miner's notions once more, in their own way: sets of renamed atoms, and loops over all renamings.


def renamings(head, body):
    own = [v for v in dict.fromkeys(t for a in body for t in (a.s, a.o) if t.startswith("?")) if v not in (head.s, head.o)]
    for order in permutations(range(len(own))):
        names = {head.s: "?x", head.o: "?y"} | {v: f"?_{i}" for v, i in zip(own, order)}
        yield frozenset((names.get(a.s, a.s), a.r, names.get(a.o, a.o)) for a in body)


def key_of(rule):
    return rule.head.r, min(renamings(rule.head, rule.body), key=sorted, default=frozenset())


def is_part(p, rule):
    return len(p.body) < len(rule.body) and p.head.r == rule.head.r and any(a <= b for a in renamings(p.head, p.body) for b in renamings(rule.head, rule.body))


def same_relation_twice(rule):
    n = Counter(a.r for a in rule.atoms)
    return rule.length >= 4 and rule.length % 2 == 0 and set(n.values()) == {2}


def share_one_side(a, b):
    return a.r == b.r and (a.s == b.s) != (a.o == b.o)


def hard(rule, new):
    """The first two atoms of one relation that share one side, if all pairs before are of one relation too; and the new atom with one of them."""
    for a, b in combinations(rule.atoms, 2):
        if a.r != b.r:
            return False
        if share_one_side(a, b):
            return share_one_side(new, a) or share_one_side(new, b)
    return False


def brute(facts, coverage, least, min_pca, most=3, heads=None):
    """All closed rules of up to ``most`` atoms that are reached level by level, with the skyline."""
    relations = sorted({r for _, r, _ in facts})
    size = {r: sum(f[1] == r for f in facts) for r in relations}
    side = {r: 0 if len({f[0] for f in facts if f[1] == r}) >= len({f[2] for f in facts if f[1] == r}) else 2 for r in relations}
    out = {}
    for h in relations:
        if size[h] < least or heads and h not in heads:
            continue
        head, need = Atom("?a", h, "?b"), max(1, math.ceil(coverage * size[h]))
        level = {key_of(Rule(head)): Rule(head, (), size[h], size[h], counted=side[h])}
        shown = []
        while level:
            nxt, measured = {}, {}
            for key, rule in level.items():
                if rule.closed:
                    body = pairs(facts, rule.body, ["?a", "?b"])
                    known = {f[side[h]] for f in facts if f[1] == h}
                    pca = sum((x if side[h] == 0 else y) in known for x, y in body)
                    rule = Rule(head, rule.body, rule.support, size[h], len(body), pca, side[h], (*rule.parents, *(p for p in shown if is_part(p, rule))))
                    good = not same_relation_twice(rule) and (rule.pca_confidence or 0) >= min_pca
                    if good and all(not p.closed or rule.pca_confidence > (p.pca_confidence or 0) for p in rule.ancestors):
                        out[key] = rule
                        measured[key] = rule
                if rule.closed and rule.perfect or rule.length >= most:
                    continue
                open_, all_ = rule.open_variables, rule.variables
                src = open_ or all_
                tgt = all_ if len(open_) <= 1 else open_
                new = []
                if not (len(open_) > 2 and rule.length == most - 1):
                    new += [Atom(*p) for v, w in product(src, tgt) if v != w for r in relations for p in ((v, r, w), (w, r, v))]
                if rule.length < most - 1:
                    fresh = f"?f{rule.length}"
                    new += [a for v in src for r in relations for a in (Atom(v, r, fresh), Atom(fresh, r, v)) if not hard(rule, a)]
                for a in new:
                    if a in rule.atoms or rule.relation_count(a.r) >= 3:
                        continue
                    n = len(pairs(facts, (*rule.atoms, a), ["?a", "?b"]))
                    if n >= need:
                        c = rule.add(a, support=n)
                        if (k := key_of(c)) in nxt:
                            old = nxt[k]
                            nxt[k] = Rule(old.head, old.body, old.support, old.head_size, counted=old.counted, parents=(*old.parents, rule))
                        else:
                            nxt[k] = c
            shown += measured.values()
            level = nxt
    return {k: (r.support, r.body_size, r.pca_body_size) for k, r in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_rules_and_metrics_as_nested_loops(spark, seed):
    rng = random.Random(seed)
    facts = sorted({(f"e{rng.randrange(6)}", f"r{rng.randrange(3)}", f"e{rng.randrange(6)}") for _ in range(32)})
    kb = spark.createDataFrame(facts, "s string, r string, o string")
    mined = Miner(kb, Config(max_atoms=3, min_head_size=3, min_head_coverage=0.3, min_pca_confidence=0.2)).mine()
    got = {key_of(r): (r.support, r.body_size, r.pca_body_size) for r in mined}
    assert got == brute(facts, 0.3, 3, 0.2)
    assert len(got) == len(mined) > 0


def test_four_atoms_as_nested_loops(spark):
    rng = random.Random(5)
    facts = sorted({(f"e{rng.randrange(4)}", f"r{rng.randrange(2)}", f"e{rng.randrange(4)}") for _ in range(11)})
    kb = spark.createDataFrame(facts, "s string, r string, o string")
    mined = Miner(kb, Config(max_atoms=4, min_head_size=3, min_head_coverage=0.6, min_pca_confidence=0.3, head_targets=frozenset(["r1"]))).mine()
    want = brute(facts, 0.6, 3, 0.3, most=4, heads=["r1"])
    assert {key_of(r): (r.support, r.body_size, r.pca_body_size) for r in mined} == want and any(r.length == 4 for r in mined)


def test_triangles_and_paths_against_all_bindings(spark):
    rng = random.Random(9)
    facts = sorted({(f"e{rng.randrange(7)}", f"r{rng.randrange(3)}", f"e{rng.randrange(7)}") for _ in range(40)} | {("e0", "r0", f"e{i}") for i in range(7)})
    kb = spark.createDataFrame(facts, "s string, r string, o string")
    edges = [(r + "+", s, o) for s, r, o in facts] + [(r + "-", o, s) for s, r, o in facts]
    want = Counter((h, lx, ly) for h, _, _, lx, ly in {(h, x, y, lx, ly) for x, h, y in facts for lx, a, z in edges if a == x for ly, b, w in edges if b == y and w == z})
    assert {(r["head"], r["lx"], r["ly"]): r["n"] for r in triangle_counts(kb, ["r0", "r1", "r2"]).collect()} == want
    rules = [(i, Rule(Atom("?a", f"r{i % 3}", "?b"), (Atom("?a", "r1", "?c") if i % 2 else Atom("?c", "r1", "?a"), Atom("?c", "r2", "?b")), counted=2 * (i % 4 // 2))) for i in range(12)]
    exact = {i: (body_size(kb, r), pca_body_size(kb, r)) for i, r in rules}
    assert path_body_sizes(spark, kb, rules) == exact
    for i, (low, high, pca_low, pca_high) in path_bounds(spark, kb, rules).items():
        assert low <= exact[i][0] <= high and pca_low <= exact[i][1] <= pca_high


def test_redundant_atoms_change_no_count(spark):
    rng = random.Random(10)
    facts = sorted({(f"e{rng.randrange(5)}", f"r{rng.randrange(2)}", f"e{rng.randrange(5)}") for _ in range(16)})
    dropped = 0
    for _ in range(60):
        atoms = [Atom("?a", "r0", "?b"), *(Atom(rng.choice(["?a", "?b", "?c", "?d"]), rng.choice(["r0", "r1"]), rng.choice(["?a", "?b", "?c", "?e"])) for _ in range(3))]
        less = without_redundant(atoms, ["?a", "?b"])
        dropped += len(less) < len(atoms)
        assert pairs(facts, atoms, ["?a", "?b"]) == pairs(facts, less, ["?a", "?b"])
    assert dropped > 5


def test_configurations(spark):
    facts = [(f"p{i}", r, f"q{i % 4}") for i in range(12) for r in ("a", "b", "c")]
    kb = spark.createDataFrame(facts, "s string, r string, o string")
    assert bias_class("rulespark.operators.miner:Miner") is Miner
    with pytest.raises(TypeError):
        bias_class("rulespark.operators.miner:Config")
    with pytest.raises(ValueError):
        Config(operators=("closing", "instantiated"))
    exact = {r.key for r in Miner(kb, Config(min_head_size=2)).mine()}
    assert {r.key for r in Miner(kb, lossy_vanilla(min_head_size=2)).mine()} <= exact
    assert Miner(kb, Config(min_head_size=2, operators=("dangling",))).mine() == []


WORKED = [("Adam", "livesIn", "Paris"), ("Adam", "livesIn", "Rome"), ("Bob", "livesIn", "Zurich"), ("Adam", "wasBornIn", "Paris"), ("Carl", "wasBornIn", "Rome")]


def test_worked_example(spark):
    kb = spark.createDataFrame(WORKED, "s string, r string, o string")
    rule = parse_rule("livesIn(?x,?y) => wasBornIn(?x,?y)")
    assert (support(kb, rule), body_size(kb, rule), pca_body_size(kb, rule)) == (1, 3, 2)
    open_rule = Rule(Atom("?y", "wasBornIn", "?z"), (Atom("?x", "livesIn", "?y"),))
    assert support(kb, open_rule) == 0


def test_constants_and_inequalities(spark):
    facts = [(f"p{i}", "livesIn", "Paris" if i % 2 else "Rome") for i in range(8)] + [(f"p{i}", "speaks", "French" if i % 2 else "Italian") for i in range(8)]
    kb = spark.createDataFrame(facts, "s string, r string, o string")
    mined = Miner(kb, Config(max_atoms=2, min_head_size=2, min_head_coverage=0.2, constants=True)).mine()
    keys = {r.key for r in mined}
    assert Rule(Atom("?a", "speaks", "French"), (Atom("?a", "livesIn", "Paris"),)).key in keys


def test_batch_equals_single(spark):
    kb = spark.createDataFrame(WORKED, "s string, r string, o string")
    rules = [parse_rule("livesIn(?x,?y) => wasBornIn(?x,?y)"), parse_rule("wasBornIn(?x,?y) => livesIn(?x,?y)"), parse_rule("livesIn(?x,?z) livesIn(?y,?z) => wasBornIn(?x,?y)")]
    assert batch_supports(spark, kb, rules) == [support(kb, r) for r in rules]


def test_registered_three_atom_query_mines_hubs(spark, monkeypatch):
    from rulespark.plans import queries

    facts = [(f"o{i}", r, f"{r}{i % 2}") for i in range(100) for r in ("hasStatus", "hasPriority")]
    facts += [(f"{r}{k}", "near", f"{q}{k}") for r, q in (("hasStatus", "hasPriority"), ("hasPriority", "hasStatus")) for k in range(2)]
    monkeypatch.setattr(queries, "derived_kb", lambda spark, d: spark.createDataFrame(facts, "s string, r string, o string"))
    got = {r["rule"] for r in queries.QUERIES["mine_closed_rules_skyline"](spark, "").collect()}
    assert any("hasStatus" in x.split("=>")[0] and x.split("=>")[0].count("?") == 4 for x in got)
    assert {x.split("=>")[1].split()[1] for x in got} == {"hasStatus", "hasPriority"}
