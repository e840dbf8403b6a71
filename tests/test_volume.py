"""What is read and shuffled, and that it is no less than the whole."""

import re

import pytest
from pyspark.sql import functions as F

from rulespark.operators import align, metrics, predict, setops
from rulespark.plans import bgp
from rulespark.plans.terms import parse_rule
from rulespark.sources.derived import derived_kb

SF = "/root/testdata/sf0.001"
PATH = "p(?x,?z) q(?z,?y) => h(?x,?y)"
FACTS = [("a", "p", "m"), ("a", "p", "n"), ("b", "p", "m"), ("m", "q", "u"), ("m", "q", "v"), ("n", "q", "v"), ("a", "h", "u"), ("c", "h", "v")]


@pytest.fixture(scope="module")
def guarded(spark):
    """Facts of a relation that fail as soon as they are read, beside the others."""
    rows = [spark.createDataFrame([f for f in FACTS if f[1] == r], "s string, r string, o string").withColumn("r", F.lit(r)) for r in "pqh"]
    bad = spark.range(1).select(F.raise_error(F.concat(F.lit("read "), F.col("id").cast("string"))).cast("string").alias("s"), F.lit("other").alias("r"), F.lit("z").alias("o"))
    return rows[0].union(rows[1]).union(rows[2]).union(bad)


def test_path_counts_read_named_relations_alone(spark, guarded):
    rule = parse_rule(PATH)
    assert metrics.path_bounds(spark, guarded, [(0, rule)]) == {0: (4, 5, 2, 3)}
    assert metrics.path_body_sizes(spark, guarded, [(0, rule)]) == {0: (4, 2)}


def test_facts_are_compared_as_keys(spark, tmp_path):
    """Repeated and null keys, and one entity in two tables' parts of a relation, give the facts that names give; names are not shuffled."""
    for name in ("nation", "part", "events", "lineitem", "orders", "customer", "supplier"):
        t = spark.read.parquet(f"{SF}/{name}.parquet").limit(40)
        keys = [c for c, kind in t.dtypes if c.endswith("key") and kind in ("bigint", "int")]
        t.union(t).union(t.limit(3).withColumns({c: F.lit(None).cast(t.schema[c].dataType) for c in keys})).write.parquet(f"{tmp_path}/{name}.parquet")
    kb = derived_kb(spark, str(tmp_path))
    assert kb.count() == kb.distinct().count() > 300
    t = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    near = [t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("s"), F.concat(F.lit("n"), "c_nationkey").alias("o")), t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"))]
    assert sorted(map(repr, kb.filter("r = 'inNation'").select("s", "o").collect())) == sorted(map(repr, near[0].union(near[1]).distinct().collect()))
    placed = t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("s"), F.concat(F.lit("c"), "o_custkey").alias("o")).distinct()
    assert sorted(map(repr, kb.filter("r = 'placedBy'").select("s", "o").collect())) == sorted(map(repr, placed.collect()))
    plan = kb.filter("r = 'hasPart'")._jdf.queryExecution().executedPlan().toString()
    assert "orders" not in plan and "hashpartitioning(k#" in plan


def test_predictions_and_verdicts_read_named_relations_alone(spark, guarded):
    rule = parse_rule(PATH)
    assert sorted(tuple(r) for r in predict.predictions(guarded, rule).collect()) == [("a", "h", "v"), ("b", "h", "u"), ("b", "h", "v")]
    assert tuple(predict.rule_overlap(guarded, rule, rule).first()) == (4, 4, 1, 1)
    target = spark.createDataFrame([("b", "h", "u")], "s string, r string, o string")
    found = predict.judged(guarded, target, [rule, rule])
    assert sorted(tuple(r) for f in found for r in f.collect()) == [(i, s, "h", o, v, k) for i in (0, 1) for s, o, v, k in (("a", "v", "False", "TrainingSource"), ("b", "u", "True", "TargetSource"), ("b", "v", "False", "TrainingSource"))]
    one = predict.evaluate(spark.createDataFrame([("a", "h", "v")], "s string, r string, o string"), guarded, target, relations=["h"]).first()
    assert (one["verdict"], one["source"]) == ("False", "TrainingSource")


def test_pairs_over_a_path_as_lists(spark, monkeypatch):
    """Long lists are cut, null ends stay, and a pair over two middles is one; the same as the joined pairs."""
    monkeypatch.setattr(bgp, "LIST", 2)
    facts = [(f"x{i}", "p", f"z{i % 3}") for i in range(9)] + [("x0", "p", "z1")] + [(f"z{i % 3}", "q", f"y{i % 7}") for i in range(21)] + [("z1", "q", None), (None, "p", "z1"), ("x0", "h", "y1")]
    kb = spark.createDataFrame(facts, "s string, r string, o string")
    rule = parse_rule(PATH)
    got = bgp.tagged([bgp.packed(kb, rule.body, "?x", "?y")])
    want = bgp.compile_query(kb, rule.body, ["?x", "?y"])
    assert sorted(repr(tuple(r)[:2]) for r in got.collect()) == sorted(repr(tuple(r)) for r in want.collect())
    row = metrics.rule_metrics(kb, rule).first()
    assert (row["body_size"], row["support"], row["pca_body_size"]) == (want.count(), 1, want.filter("x = 'x0'").count())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.rpartition("Initial Plan")[2].count("hashpartitioning(x#") == 1


def test_cross_rules_count_on_sets(spark):
    """Loops, both directions and null ends against a nested loop; facts are shuffled by their pair once and never joined with each other."""
    one = [("a", "p", "b"), ("b", "p", "a"), ("a", "p", "a"), ("c", "q", "a"), ("a", "q", "c"), ("b", "q", None), ("d", "p", "d")]
    two = [("a", "P", "b"), ("a", "P", "a"), ("a", "Q", "c"), ("c", "Q", "a"), ("b", "P", None), ("d", "P", "a")]
    frames = [spark.createDataFrame(x, "s string, r string, o string") for x in (one, two)]
    got = {(r["body"], r["head"], r["inverse"]): (r["support"], r["body_size"], r["pca_body_size"]) for r in align.cross_rules(*frames, least=1).collect()}
    want = {}
    for bodies, heads in ((one, two), (two, one)):
        for body in {r for _, r, _ in bodies}:
            for head in {r for _, r, _ in heads}:
                for inverse in (False, True):
                    b = [(o, s) if inverse else (s, o) for s, r, o in bodies if r == body]
                    h = [(s, o) for s, r, o in heads if r == head]
                    n = sum(1 for p in b if p in h and None not in p)
                    k = 0 if len({s for s, _ in h}) >= len({o for _, o in h}) else 1
                    if n:
                        want[body, head, inverse] = n, len(b), sum(1 for p in b if p[k] is not None and p[k] in {x[k] for x in h})
    assert got == want and len(got) > 6


def test_bindings_are_not_shuffled_where_no_variable_goes(spark, monkeypatch):
    """Repeated facts and null ends; bindings of all variables are distinct without being compared, and what is taken out of them is found by lists."""
    monkeypatch.setattr(bgp, "LIST", 2)
    facts = [(f"x{i % 4}", "p", f"y{i % 3}") for i in range(12)] + [(f"y{i % 3}", "q", f"z{i % 5}") for i in range(30)] + [(f"z{i}", "n", f"w{i % 2}") for i in range(5)]
    facts += [("x0", "p", None), (None, "p", "y1"), ("y1", "q", None), ("x1", "n", "w1"), (None, "n", "w0"), ("x2", "d", "z1"), ("x2", "d", None), (None, "d", "z2"), ("x3", "e", "k"), ("x3", "e", "l")]
    kb = spark.createDataFrame(facts, "s string, r string, o string")
    have = {r: {(s, o) for s, k, o in facts if k == r} for r in "pqnde"}
    xyz = {(x, y, z) for x, y in have["p"] for a, z in have["q"] if y == a and y is not None}
    xyzw = {(*t, w) for t in xyz for a, w in have["n"] if t[2] == a and a is not None}
    atom = lambda text: [bgp.Atom(*a.split()) for a in text.split(";")]
    same = lambda rows, want: sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want)) and len(want) > 3
    two, three = atom("?x p ?y;?y q ?z"), atom("?x p ?y;?y q ?z;?z n ?w")
    got = bgp.compile_query(kb, two, ["?x", "?y", "?z"])
    assert same(got, xyz) and bgp.count_distinct(kb, ["?x", "?y", "?z"], two) == len(xyz)
    assert got._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith(("Project", "Join"))
    assert same(bgp.compile_query(kb, three, ["?w", "?x", "?y", "?z"]), {(t[3], *t[:3]) for t in xyzw})
    got = bgp.difference(kb, ["?x", "?y", "?z"], two, atom("?x d ?z"))
    assert same(got, {t for t in xyz if (t[0], t[2]) not in have["d"] or None in (t[0], t[2])})
    assert "Join LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = bgp.difference(kb, ["?z", "?x", "?y", "?w"], three, atom("?x n ?w"))
    assert same(got, {(z, x, y, w) for x, y, z, w in xyzw if (x, w) not in have["n"] or None in (x, w)})
    assert same(bgp.difference_no_vars_in_common(kb, ["?x", "?y", "?z", "?w"], three, bgp.Atom("?x", "e", "?v")), {t for t in xyzw if t[0] != "x3"})
    assert bgp.compile_query(kb, atom("?x p ?y;z0 n w9"), ["?x", "?y"], product=True).count() == 0  # an atom of constants that is no fact
    counts = {r: len({(x, y) for x, y in have["p"] for s, k, _ in facts if s == x and s is not None and k == r}) for r in "pqnde"}
    got = bgp.count_projection_bindings(kb, bgp.Atom("?x", "p", "?y"), atom("?x ?r ?z"), "?r")
    assert {r["r"]: r["n"] for r in got.collect()} == {r: n for r, n in counts.items() if n}


def test_sides_go_to_the_facts(spark):
    """No task reads a whole relation."""
    kb = spark.createDataFrame(FACTS, "s string, r string, o string").repartition(3)
    few = spark.createDataFrame([("a",), ("m",), ("v",)], "e string")
    for rows in (setops.materialise_inverses(kb), setops.relevance_filter(kb, few), setops.drop_small_relations(kb, 3)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"\w+Join \[r#", plan)[0].startswith("BroadcastHashJoin")
    assert sorted(map(tuple, setops.drop_small_relations(kb, 3).collect())) == sorted(f for f in FACTS if f[1] in "pq")


def test_triples_are_written_once_and_compressed(spark, monkeypatch):
    import glob

    from rulespark.plans import more_queries

    paths, written = [], more_queries._written
    monkeypatch.setattr(more_queries, "_written", lambda *a: paths.append(written(*a)) or paths[-1])
    rows = more_queries._renamed_literals(spark, SF)
    assert len(paths) == 1 and rows.filter("r like '%inSegmentc>'").count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    files = [f for f in glob.glob(f"{paths[0].removeprefix('file://')}/*/*") if not f.endswith("_SUCCESS")]
    assert files and all(f.endswith(".gz") for f in files)


def test_overlaps_and_paths_read_the_facts_once(spark, monkeypatch):
    """Null ends, loops and an entity on both sides against nested loops; after one count of sets the facts are not read again."""
    from rulespark.operators import estimates, stats

    plans, stored = [], stats.stored
    monkeypatch.setattr(stats, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    facts = [*FACTS, ("a", "q", "a"), (None, "p", "m"), ("b", "h", None), ("v", "p", "a")]
    kb = spark.createDataFrame(facts, "s string, r string, o string")
    reads = lambda plan: plan.count("LogicalRDD") + plan.count("LocalRelation")
    got = stats.overlap_report(kb)
    assert [reads(p) for p in plans] == [1] and reads(got._jdf.queryExecution().optimizedPlan().toString()) == 0
    side = {(r, c): {f[k] for f in facts if f[1] == r} - {None} for r in "pqh" for k, c in ((0, "s"), (2, "o"))}
    want = {(a, b): [len(side[a, x] & side[b, y]) for x, y in ("ss", "so", "os", "oo")] + [len(side[k]) for k in ((a, "s"), (a, "o"), (b, "s"), (b, "o"))] for a in "pqh" for b in "pqh" if a != b}
    assert {(r["r1"], r["r2"]): list(tuple(r)[2:]) for r in got.collect()} == {k: v for k, v in want.items() if any(v[:4])}
    got = estimates.path_bodies(kb, 1)
    assert [reads(p) for p in plans] == [1, 1] and reads(got._jdf.queryExecution().optimizedPlan().toString()) == 0
    n = {r: sum(f[1] == r for f in facts) for r in "pqh"}
    pairs = {(r["h"], r["l1"]): r["pairs"] for r in got.collect()}
    assert pairs["h", "q+"] == pytest.approx(len(side["h", "s"] & side["q", "s"]) * n["q"] / len(side["q", "s"]))


def test_signed_overlaps_read_the_facts_once(spark, monkeypatch):
    """Entities of two types and of none against nested loops."""
    plans, stored = [], setops.stored
    monkeypatch.setattr(setops, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    facts = [(f"x{i % 4}", r, f"y{i % 3}") for i in range(12) for r in "pqt" if (i * (ord(r) % 5 + 1)) % 3] + [("x0", "t", "z"), (None, "p", "y1"), ("x1", "q", None)]
    kinds = [("x0", "A"), ("x0", "B"), ("x1", "A"), ("x2", "A"), ("y0", "C"), ("y1", "C"), ("y1", "A"), ("y2", "C")]
    facts = sorted(set(facts), key=repr)
    got = setops.signed_overlaps(spark.createDataFrame(facts, "s string, r string, o string"), spark.createDataFrame(kinds, "e string, type string"))
    assert len(plans) == 1 and plans[0].count("LogicalRDD") + plans[0].count("LocalRelation") == 3  # the facts, and types of either end
    typed = [(r, a, b, s, o) for s, r, o in facts for e, a in kinds for f, b in kinds if e == s and f == o]
    want = {}
    for r1, r2 in [(a, b) for a in "pqt" for b in "pqt" if a != b]:
        for a, b in {t[1:3] for t in typed}:
            pairs = lambda r: {t[3:] for t in typed if t[:3] == (r, a, b)}  # noqa: B023, E731
            known = lambda r, other: sum(any(f[:2] == (s, other) for f in facts) for s, _ in pairs(r))  # noqa: B023, E731
            n = len(pairs(r1) & pairs(r2))
            if n > 1 and min(len(pairs(r1)), len(pairs(r2))) >= 3:
                want[r1, r2, a, b] = (n, n / known(r1, r2), n / known(r2, r1))
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()} == want and want


def test_coalesced_facts_are_derived_once(spark):
    """Null ends, repeated facts, facts of both; neither side is read again after it is stored."""
    a = [("x", "p", "y"), ("x", "p", "y"), ("w", "p", "z"), (None, "p", "v"), ("u", "q", None)]
    b = [("x", "P", "k"), ("y", "P", "x"), ("y", "P", "m"), ("m", "P", "n"), ("n", "P", "o"), ("x", "p", "y"), (None, "P", "x"), ("v", "P", None), ("v", "P", None)]
    frames = [spark.createDataFrame(f, "s string, r string, o string") for f in (a, b)]
    keep = {s for s, _, _ in b} & ({f[0] for f in a} | {f[2] for f in a}) - {None}
    want = {f for f in a + b if f[0] in keep}
    more = {o for s, _, o in b if s in keep} - keep - {None}
    for with_objects, facts in ((False, want), (True, want | {f for f in b if f[0] in more})):
        got = setops.coalesce(*frames, with_objects=with_objects)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, facts))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "LocalRelation" not in plan


def test_instantiated_heads_are_not_dealt_by_their_constant(spark):
    """No relation and constant is one task's work; counts against nested loops, with null ends."""
    from rulespark.operators import biases

    facts = [(f"x{i}", "p", f"c{i % 2}") for i in range(9)] + [(f"x{i}", "q", f"d{i % 3}") for i in range(0, 9, 2)] + [("c0", "t", "x1"), (None, "p", "c1"), ("x1", "q", None)]
    got = biases.instantiated_head_rules(spark.createDataFrame(facts, "s string, r string, o string"), 2)
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()
    has = {(r, "s", s) for s, r, o in facts} | {(r, "o", o) for s, r, o in facts}
    want = {}
    for r in "pqt":
        own = [(s, o) for s, k, o in facts if k == r]
        x = 0 if len({s for s, _ in own} - {None}) >= len({o for _, o in own} - {None}) else 1
        for f in own:
            for body, side, e in has:
                if e == f[x] is not None and (body, side) != (r, "so"[x]):
                    want[r, "so"[x], f[1 - x], body, side] = want.get((r, "so"[x], f[1 - x], body, side), 0) + 1
    want = {k: n for k, n in want.items() if n >= 2}
    assert {tuple(r)[:5]: r["support"] for r in got.collect()} == want and want
    assert all(r["body_size"] == sum(h[:2] == (r["body"], r["side"]) for h in has) for r in got.collect())


def test_triangles_are_counted_on_numbers(spark):
    from rulespark.plans import more_queries

    plan = more_queries._triangles(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "o_custkey" not in plan


def test_link_rules_read_relations_that_can_meet(spark):
    """Relations without entities on both sides of the links are not compared; counts against nested loops."""
    from rulespark.operators import biases

    rows = [(f"a{i}", "link", f"b{j}") for i in range(5) for j in range(4) if (i + j) % 3] + [(f"a{i}", "p", f"b{i % 4}") for i in range(5)] + [("a1", "q", "z"), ("z", "q", "b1"), ("z", "t", "z2"), ("a2", "p", "z")]
    types = [(f"a{i}", "rdf:type", "A") for i in range(5)] + [("a1", "rdf:type", "B")] + [(f"b{i}", "rdf:type", "C") for i in range(3)]
    kb, meta = (spark.createDataFrame(x, "s string, r string, o string") for x in (rows, types))
    got = {(r["domain"], r["range"], r["r"]): (r["support"], r["body_size"], r["pca_body_size"]) for r in biases.link_rules(kb, meta, "link", 1).collect()}
    body = [(s, o, c, d) for s, r, o in rows if r == "link" for e, _, c in types if e == s for f, _, d in types if f == o]
    want = {}
    for c, d in {b[2:] for b in body}:
        own = [b[:2] for b in body if b[2:] == (c, d)]
        known = {s for s, r, _ in rows if r == "p"}  # p: 5 subjects, 5 objects
        n = sum((s, "p", o) in rows for s, o in own)
        if n:
            want[c, d, "p"] = n, len(own), sum(s in known for s, _ in own)
    assert got == want and want
    read = []
    inner = kb.filter
    kb.filter = lambda test: read.append(str(test)) or inner(test)
    biases.link_rules(kb, meta, "link", 1)
    assert any("IN" in t.upper() and "p" in t for t in read) and not any("t" in t.split("IN")[-1].split(",") for t in read if " IN" in t)


def test_constant_rules_make_no_pairs_of_entities(spark, monkeypatch):
    """The same rules as the miner's of one variable, without the miner."""
    from rulespark.operators import biases, miner

    rows = [(f"x{i}", "p", f"c{i % 3}") for i in range(120)] + [(f"x{i}", "q", f"d{i % 4}") for i in range(0, 120, 2)] + [(f"x{i}", "q", "d9") for i in range(0, 120, 3)]
    kb = spark.createDataFrame(rows, "s string, r string, o string")
    config = miner.Config(max_atoms=2, min_head_size=50, min_head_coverage=0.05)
    want = [r for r in miner.Miner(kb, miner.Config(max_atoms=2, min_head_size=50, min_head_coverage=0.05, constants=True)).mine() if len(r.variables) == 1]
    monkeypatch.setattr(miner.Miner, "mine", lambda self: pytest.fail("mined"))
    plain = lambda rules: sorted((miner.canonical_text(r), r.support, r.head_size, r.body_size, r.pca_body_size, r.counted) for r in rules)
    assert plain(biases.constant_rules(kb, config)) == plain(want) and want


def test_triangles_look_only_at_labels_that_can_close(spark):
    """By nested loops, with loops and several labels; labels whose other ends never meet the head's other side are left out."""
    rows = [(f"x{i}", "h", f"y{i % 4}") for i in range(9)] + [(f"x{i}", "p", f"z{i % 3}") for i in range(9)] + [(f"z{i % 3}", "q", f"y{i}") for i in range(4)] + [(f"x{i}", "far", f"w{i}") for i in range(9)] + [("x1", "q", "x1"), ("y1", "p", "x1")]
    kb = spark.createDataFrame(rows, "s string, r string, o string")
    known = ["far", "h", "p", "q"]
    want = {}
    edges = [(2 * known.index(r), s, o) for s, r, o in rows] + [(2 * known.index(r) + 1, o, s) for s, r, o in rows]
    name = lambda l: known[l // 2] + "+-"[l % 2]
    for s, r, o in rows:
        for pair in {(lx, ly) for lx, a, z in edges if a == s for ly, b, w in edges if b == o and w == z}:
            want[r, name(pair[0]), name(pair[1])] = want.get((r, name(pair[0]), name(pair[1])), 0) + 1
    got = {(r["head"], r["lx"], r["ly"]): r["n"] for r in metrics.triangle_counts(kb, known).collect()}
    assert got == want
    numbered = spark.createDataFrame(edges, "l int, a string, b string")
    by_x, by_y = metrics.closing_labels(numbered, [1])
    assert 0 not in by_x[1] and 4 in by_x[1] and 7 in by_y[1]


def test_relations_are_looked_up_apart_from_their_facts(spark):
    """Names of relations, whole or without the last character, and no join that deals all facts by relation."""
    from rulespark.sources import readers

    triples = spark.createDataFrame([("<a>", "<r>", "<b>"), ("<a>", "<r>", "<b>"), ("<a>", "<qc>", "<b>"), ("<b>", "<x>", "<c>"), ("<c>", "<r>", "<a>"), ("<a>", "<rc>", '"1"^^<int>')], "s string, r string, o string")
    names = spark.createDataFrame([("<a>", "<A>"), ("<b>", "<B>"), ("<q>", "<Q>"), ("<r>", "<R>"), ("<rc>", "<RC>")], "id string, name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = readers.rename_entities(triples, names, literals=True)
        assert sorted(map(tuple, found.collect())) == [("<A>", "<Q>", "<B>"), ("<A>", "<R>", "<B>"), ("<A>", "<RC>", '"1"'), ("<B>", "<x>", '"<c>"')]
        assert found._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 2  # subjects and objects
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
