"""Support and confidences, of one rule and of whole batches of rules.

A batch is evaluated by shape: rules whose atoms share variables in the same way become rows of a parameter table (rule number, relation
and constant of each atom), which is joined with the facts atom by atom. One job answers all rules of a shape, however many.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespark.operators.storage import stored
from rulespark.plans.bgp import compile_query, facts_packed, packed, tagged
from rulespark.plans.terms import DIFFERENT, Atom, Rule, is_variable, pca_query, plain, variables_of, without_redundant

#: Rules in one parameter table; it is sent to all tasks, so this is its size bound.
BATCH = 20_000


#: Shapes of rules in one job.
SHAPES = 12


def collected(parts: Sequence[DataFrame]):
    """The rows of all frames, ``SHAPES`` of them in a job."""
    for k in range(0, len(parts), SHAPES):
        yield from reduce(DataFrame.unionAll, parts[k : k + SHAPES]).collect()


# --- one rule


def support(kb: DataFrame, rule: Rule) -> int:
    return compile_query(kb, rule.atoms, rule.head.variables).count()


def body_size(kb: DataFrame, rule: Rule) -> int:
    return compile_query(kb, rule.body, rule.head.variables).count()


def pca_body_size(kb: DataFrame, rule: Rule) -> int:
    return compile_query(kb, pca_query(rule), rule.head.variables).count()


def rule_metrics(kb: DataFrame, rule: Rule, text: str | None = None) -> DataFrame:
    """One row with a rule's metrics. The functional side is found from the facts: the head's subject if its functionality is at least as high as the
    inverse. Body and head are matched by subject, where their pairs are shuffled once; counts alone go on from there."""
    from rulespark.plans.terms import native_text

    (x, y), head = rule.head.variables, kb.filter(F.col("r") == rule.head.r)
    sides = head.agg(F.count("*").alias("head_size"), F.count_distinct("s").alias("a"), F.count_distinct("o").alias("b"))
    known = facts_packed(kb, rule.head.r).filter("x IS NOT NULL AND ys[0] IS NOT NULL")  # null is equal to nothing
    rows = tagged([packed(kb, rule.body, x, y), known]).filter("tags & 1 = 1")
    n, hits = F.count("*").alias("n"), F.count(F.when(F.col("tags") == 3, 1)).alias("hits")
    by = lambda pair, fact: rows.groupBy(F.col(pair).alias("e")).agg(n, hits).join(head.select(F.col(fact).alias("e")).distinct().withColumn("known", F.lit(1)), "e", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("body_size"), F.coalesce(F.sum("hits"), F.lit(0)).alias("support"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("pca"))
    functional = F.col("a") >= F.col("b")
    one = sides.first()
    got = by("x", "s") if one["a"] >= one["b"] else by("y", "o")
    pca = F.col("pca")
    return got.join(spark_row(kb, one), F.lit(True)).select(
        F.lit(text or native_text(rule)).alias("rule"),
        F.try_divide(F.col("support").cast("double"), F.col("head_size").cast("double")).alias("head_coverage"),
        F.try_divide(F.col("support").cast("double"), F.col("body_size").cast("double")).alias("std_confidence"),
        F.try_divide(F.col("support").cast("double"), pca.cast("double")).alias("pca_confidence"),
        "support",
        "body_size",
        pca.alias("pca_body_size"),
        F.when(functional, rule.head.s).otherwise(rule.head.o).alias("functional_variable"),
    )


def spark_row(kb: DataFrame, row) -> DataFrame:
    return kb.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{c} long" for c in row.asDict()))


# --- batches


def shape_of(atoms: Sequence[Atom]) -> tuple:
    """How atoms share variables: places by number, constants as None; inequalities as they are."""
    number: dict[str, int] = {}
    out = []
    for a in atoms:
        if plain(a.r) == DIFFERENT:
            out.append(("!=", number.get(a.s, -1), number.get(a.o, -1)))
        else:
            out.append(tuple(number.setdefault(t, len(number)) if is_variable(t) else None for t in (a.s, a.o)))
    return tuple(out)


def by_shape(queries: Sequence[tuple[int, Sequence[Atom]]]) -> dict[tuple, list[tuple[int, Sequence[Atom]]]]:
    groups: dict[tuple, list] = defaultdict(list)
    for i, atoms in queries:
        groups[shape_of(atoms)].append((i, atoms))
    out = {}
    for shape, members in groups.items():
        for k in range(0, len(members), BATCH):
            out[shape, k] = members[k : k + BATCH]
    return {(shape, k): m for (shape, k), m in out.items()}


def batch_bindings(spark: SparkSession, kb: DataFrame, members: list[tuple[int, Sequence[Atom]]], kept: Sequence[int], distinct: bool = True) -> DataFrame:
    """``rid`` and ``v<number>`` for the kept variables of queries of one shape, distinct. A column that no later atom needs goes, with
    its duplicates, as soon as it can."""
    atoms = members[0][1]
    shape = shape_of(atoms)
    normal = [i for i, a in enumerate(atoms) if plain(a.r) != DIFFERENT]
    unequal = [i for i, a in enumerate(atoms) if plain(a.r) == DIFFERENT]
    columns = ["rid long"] + [f"r{i} string, s{i} string, o{i} string" for i in range(len(atoms))]
    params = spark.createDataFrame([(rid, *(t for a in own for t in (a.r, a.s, a.o))) for rid, own in members], ", ".join(columns))
    params = F.broadcast(params)  # at most BATCH rows
    rows, done = None, set()
    number = {v: k for k, v in enumerate(variables_of(atoms[i] for i in normal))}
    for step, i in enumerate(normal):
        sn, on = shape[i]
        fact = kb.select(F.col("r").alias("fr"), F.col("s").alias("fs"), F.col("o").alias("fo"))
        if sn is not None and sn == on:
            fact = fact.filter("fs = fo")
        left = params.select("rid", f"r{i}", *[f"{c}{i}" for c, n in (("s", sn), ("o", on)) if n is None])
        if rows is None:
            rows, conditions = left, []
        else:
            rows = rows.join(left, "rid")
            conditions = [F.col(f"v{n}") == F.col(f"f{c}") for c, n in (("s", sn), ("o", on)) if n in done]
        conditions.append(F.col(f"r{i}") == F.col("fr"))
        conditions += [F.col(f"{c}{i}") == F.col(f"f{c}") for c, n in (("s", sn), ("o", on)) if n is None]
        later = {n for j in normal[step + 1 :] for n in shape[j] if n is not None} | set(kept) | {number[t] for j in unequal for t in (atoms[j].s, atoms[j].o) if t in number}
        new = {n: F.col(f"f{c}").alias(f"v{n}") for c, n in (("o", on), ("s", sn)) if n is not None and n not in done}
        wanted = {n: c for n, c in new.items() if n in later}
        if len(wanted) < len(new):  # existential: only whether there is a fact
            needed = [f"f{c}" for c, n in (("s", sn), ("o", on)) if n in done or n in wanted or n is None]
            fact = fact.select("fr", *needed).distinct()
        rows = rows.join(fact, reduce(lambda a, b: a & b, conditions)).select("rid", *[f"v{n}" for n in sorted(done & later)], *[c for _, c in sorted(wanted.items())])
        dropped = done - later
        done = (done & later) | set(wanted)
        if dropped:
            rows = rows.distinct()
    for i in unequal:
        a = atoms[i]
        rows = rows.join(params.select("rid", F.col(f"s{i}").alias("us"), F.col(f"o{i}").alias("uo")), "rid")
        one = lambda t, c: F.col(f"v{number[t]}") if t in number else F.col(c)
        rows = rows.filter(one(a.s, "us") != one(a.o, "uo")).drop("us", "uo")
    rows = rows.select("rid", *[f"v{n}" for n in kept])
    return rows.distinct() if distinct else rows


def batch_counts(spark: SparkSession, kb: DataFrame, queries: Sequence[tuple[int, Sequence[Atom], Sequence[str]]]) -> dict[int, int]:
    """For each query (number, atoms, variables) its distinct bindings; one job for each shape."""
    counted = {i: v for i, _, v in queries}
    out = dict.fromkeys(counted, 0)
    groups: dict[tuple, list] = defaultdict(list)
    for (shape, k), members in by_shape([(i, a) for i, a, _ in queries]).items():
        for i, atoms in members:
            number = {v: n for n, v in enumerate(variables_of(a for a in atoms if plain(a.r) != DIFFERENT))}
            groups[shape, k, tuple(sorted(number[v] for v in counted[i]))].append((i, atoms))
    parts = [batch_bindings(spark, kb, members, kept).groupBy("rid").agg(F.count("*").alias("n")) for (_, _, kept), members in groups.items()]
    for row in collected(parts):
        out[row["rid"]] = row["n"]
    return out


def batch_supports(spark: SparkSession, kb: DataFrame, rules: Sequence[Rule]) -> list[int]:
    got = batch_counts(spark, kb, [(i, without_redundant(r.atoms, r.head.variables), r.head.variables) for i, r in enumerate(rules)])
    return [got[i] for i in range(len(rules))]


# --- rules of three variables: labelled edges


def labelled_edges(kb: DataFrame) -> DataFrame:
    """``l``, ``a``, ``b``: each fact from both its ends, as relation with ``+`` from subject to object and with ``-`` back."""
    return kb.select(F.concat("r", F.lit("+")).alias("l"), F.col("s").alias("a"), F.col("o").alias("b")).unionAll(kb.select(F.concat("r", F.lit("-")), F.col("o"), F.col("s")))


def chosen_edges(kb: DataFrame, labels: Collection[str]) -> DataFrame:
    """Labelled edges of these labels; facts of other relations are not read."""
    of = lambda sign: kb.filter(F.col("r").isin([x[:-1] for x in sorted(labels) if x[-1] == sign]))
    return of("+").select(F.concat("r", F.lit("+")).alias("l"), F.col("s").alias("a"), F.col("o").alias("b")).unionAll(of("-").select(F.concat("r", F.lit("-")), F.col("o"), F.col("s")))


def chosen_domains(kb: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """``counted``, ``h``, ``u``: entities on the counted side of the rules' heads."""
    of = lambda counted: kb.filter(F.col("r").isin(sorted({r.head.r for _, r in rules if r.counted == counted})))
    return of(0).select(F.lit(0).alias("counted"), F.col("r").alias("h"), F.col("s").alias("u")).union(of(2).select(F.lit(2), "r", "o")).distinct()


def coded(kb: DataFrame) -> DataFrame:
    """The facts with entities as numbers, for counts that need no names; stored, as the numbers are only good for one run."""
    ids = stored(kb.select(F.col("s").alias("e")).union(kb.select("o")).distinct().withColumn("id", F.monotonically_increasing_id()), "entities")
    rows = kb.join(ids.select(F.col("e").alias("s"), F.col("id").alias("si")), "s").join(ids.select(F.col("e").alias("o"), F.col("id").alias("oi")), "o")
    return stored(rows.select(F.col("si").alias("s"), "r", F.col("oi").alias("o")), "coded")


def label(atom: Atom, start: str) -> str:
    return atom.r + ("+" if atom.s == start else "-")


def closing_labels(edges: DataFrame, heads: Sequence[int]) -> tuple[dict[int, set[int]], dict[int, set[int]]]:
    """For each head relation the labels by which its subjects, and those by which its objects, may reach the third entity of a triangle: some entity has both labels turned, and the head's
    subject or object has its own. Read off the pairs of labels that entities have together."""
    own = edges.groupBy("a").agg(F.collect_set("l").alias("ls")).groupBy("ls").agg(F.count("*").alias("_"))
    both = own.select("ls", F.explode("ls").alias("p")).select("p", F.explode("ls").alias("q")).distinct().collect()  # a row per pair of labels
    met: dict[int, set[int]] = defaultdict(set)
    for r in both:
        met[r["p"]].add(r["q"])
    of = lambda own, other: {l for l in met[own] if any(m ^ 1 in met[l ^ 1] for m in met[other])}
    return {h: of(2 * h, 2 * h + 1) for h in heads}, {h: of(2 * h + 1, 2 * h) for h in heads}


def triangles(kb: DataFrame, known: Sequence[str], relations: Sequence[str]) -> DataFrame:
    """``x``, ``y``, ``heads``, ``lx``, ``ly``: for each pair joined by a head relation and each entity z next to both, the labels from x and from y to z. Relations are
    their places in ``known``, labels twice that, one more for objects. One plan for all: a head fact looks for z from whichever of its ends has fewer
    facts, so hubs are never expanded; only facts with labels that can close a triangle over the head are looked at (:func:`closing_labels`)."""
    numbers = kb.sparkSession.createDataFrame([(r, i) for i, r in enumerate(known)], "r string, rn int")
    kb = kb.join(F.broadcast(numbers), "r").select("s", F.col("rn").alias("r"), "o")  # a row per relation
    chosen = set(relations)
    edges = kb.select((2 * F.col("r")).alias("l"), F.col("s").alias("a"), F.col("o").alias("b")).unionAll(kb.select(2 * F.col("r") + 1, F.col("o"), F.col("s")))
    head_numbers = [i for i, r in enumerate(known) if r in chosen]
    allowed = dict(zip("xy", closing_labels(edges, head_numbers)))
    use = {c: sorted(set().union(*allowed[c].values())) for c in "xy"}
    edges = edges.filter(F.col("l").isin(sorted({*use["x"], *use["y"]})))
    facts = kb.filter(F.col("r").isin([h for h in head_numbers if allowed["x"][h]]))
    # a bit for each label that may close a triangle over the head; with more labels than bits all may
    few = 2 * len(known) <= 62
    masks = {c: F.array(*[F.lit(sum(1 << l for l in allowed[c].get(h, ())) if few else -1).cast("long") for h in range(len(known))]) for c in "xy"}
    degree = edges.groupBy("a", "l").agg(F.count("*").alias("n")).groupBy("a").agg(F.collect_list(F.struct("l", "n")).alias("own"))
    pairs = edges.groupBy("a", "b").agg(F.collect_set("l").alias("ls"))
    sized = facts.groupBy(F.col("s").alias("x"), F.col("o").alias("y")).agg(F.collect_set("r").alias("heads"), *[F.bit_or(F.get(masks[c], F.col("r"))).alias(f"m{c}") for c in "xy"])
    for c in "xy":
        deg = F.expr(f"aggregate(own, 0L, (acc, p) -> acc + if({'shiftright(m' + c + ', p.l) & 1 = 1' if few else 'true'}, p.n, 0L))")
        sized = sized.join(degree.withColumnRenamed("a", c), c).withColumn(f"d{c}", deg).drop("own").filter(F.col(f"d{c}") > 0)
    parts = []
    for first, second, keep in (("x", "y", F.col("dx") <= F.col("dy")), ("y", "x", F.col("dx") > F.col("dy"))):
        near = lambda c: pairs.select(F.col("a").alias(c), F.col("b").alias("z"), F.filter("ls", lambda l: l.isin(use[c])).alias(f"l{c}")).filter(F.size(f"l{c}") > 0)
        rows = sized.filter(keep).join(near(first), first)
        if few:
            rows = rows.withColumn(f"l{first}", F.expr(f"filter(l{first}, l -> shiftright(m{first}, l) & 1 = 1)"))
        rows = rows.filter(F.size(f"l{first}") > 0).select("x", "y", "z", "heads", f"l{first}")
        rows = rows.join(near(second), [second, "z"])
        parts.append(rows.select("x", "y", "heads", "lx", "ly"))
    return parts[0].unionAll(parts[1])


def triangle_counts(kb: DataFrame, relations: Sequence[str]) -> DataFrame:
    """``head``, ``lx``, ``ly``, ``n``: for each head relation and pair of labels the head facts (x, y) with an entity z that x reaches by ``lx`` and y by ``ly``."""
    known = sorted(r["r"] for r in kb.select("r").distinct().collect())  # a row per relation
    rows = triangles(kb, known, relations).select("x", "y", "heads", F.explode("lx").alias("lx"), "ly").select("x", "y", "heads", "lx", F.explode("ly").alias("ly"))
    hits = rows.groupBy("x", "y", "lx", "ly").agg(F.first("heads").alias("heads")).select(F.explode("heads").alias("head"), "lx", "ly").groupBy("head", "lx", "ly").agg(F.count("*").alias("n"))
    heading = F.element_at(F.array(*map(F.lit, known)), F.col("head") + 1)
    side = F.array(*[F.lit(r + d) for r in known for d in "+-"])
    return hits.select(heading.cast("string").alias("head"), F.element_at(side, F.col("lx") + 1).alias("lx"), F.element_at(side, F.col("ly") + 1).alias("ly"), "n")


def path_of(rule: Rule) -> tuple[str, str] | None:
    """The labels of a two-atom body from the counted variable over a third one to the other; None for other rules."""
    if len(rule.body) != 2 or len(rule.variables) != 3 or not all(map(is_variable, (rule.head.s, rule.head.o))) or rule.head.s == rule.head.o:
        return None
    start, end = (rule.head.s, rule.head.o) if rule.counted == 0 else (rule.head.o, rule.head.s)
    for one, two in (rule.body, rule.body[::-1]):
        mid = [v for v in (one.s, one.o) if v != start]
        if one.special or two.special or len(mid) != 1 or not is_variable(mid[0]) or start not in (one.s, one.o):
            continue
        if {two.s, two.o} == {mid[0], end} and mid[0] != end:
            return label(one, start), label(two, mid[0])
    return None


def path_bounds(spark: SparkSession, kb: DataFrame, rules: Sequence[tuple[int, Rule]]) -> dict[int, tuple[int, int, int, int]]:
    """For path rules: bounds (lowest, highest) of the body size and of the PCA body size, from fan-outs alone. An entity reaches no fewer others than
    over the best of its middles and no more than over all of them; the two agree where each entity has one middle."""
    paths = {i: path_of(r) for i, r in rules}
    wanted = spark.createDataFrame([(i, *paths[i], r.head.r, r.counted) for i, r in rules], "rid long, l1 string, l2 string, h string, counted int")
    pairs = wanted.select("l1", "l2").distinct()
    edges = lambda k: chosen_edges(kb, {p[k] for p in paths.values()})
    fan = edges(1).groupBy(F.col("l").alias("l2"), F.col("a").alias("z")).agg(F.count("*").alias("d"))
    fan = fan.join(F.broadcast(pairs), "l2")  # at most BATCH rows
    first = edges(0).select(F.col("l").alias("l1"), F.col("a").alias("u"), F.col("b").alias("z"))
    reach = first.join(fan, ["l1", "z"]).groupBy("l1", "l2", "u").agg(F.max("d").alias("low"), F.sum("d").alias("high"))
    total = reach.groupBy("l1", "l2").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    own = chosen_domains(kb, rules)
    heads = wanted.select("l1", "l2", "h", "counted").distinct()
    pca = reach.join(F.broadcast(heads), ["l1", "l2"]).join(own, ["h", "counted", "u"], "left_semi").groupBy("l1", "l2", "h", "counted").agg(F.sum("low").alias("pca_low"), F.sum("high").alias("pca_high"))
    rows = wanted.join(total, ["l1", "l2"], "left").join(pca, ["l1", "l2", "h", "counted"], "left").fillna(0, ["low", "high", "pca_low", "pca_high"])
    return {r["rid"]: (r["low"], r["high"], r["pca_low"], r["pca_high"]) for r in rows.collect()}


def path_body_sizes(spark: SparkSession, kb: DataFrame, rules: Sequence[tuple[int, Rule]]) -> dict[int, tuple[int, int]]:
    """Exact body sizes of path rules, one plan for all: pairs of labels are followed once, however many heads have them as bodies."""
    paths = {i: (*path_of(r), r.head.r, r.counted) for i, r in rules}
    number = {p: k for k, p in enumerate(dict.fromkeys(p[:2] for p in paths.values()))}
    pairs = spark.createDataFrame([(k, *p) for p, k in number.items()], "pid int, l1 string, l2 string")
    wanted = spark.createDataFrame([(i, number[p[:2]], *p[2:]) for i, p in paths.items()], "rid long, pid int, h string, counted int")
    first = chosen_edges(kb, {p[0] for p in number}).join(F.broadcast(pairs), F.col("l") == F.col("l1")).select("pid", "l2", F.col("a").alias("u"), F.col("b").alias("z"))  # at most BATCH rows
    second = chosen_edges(kb, {p[1] for p in number}).select(F.col("l").alias("l2"), F.col("a").alias("z"), F.col("b").alias("w"))
    reached = first.join(second, ["l2", "z"]).select("pid", "u", "w").distinct().groupBy("pid", "u").agg(F.count("*").alias("n"))
    own = chosen_domains(kb, rules).withColumn("known", F.lit(1))
    rows = reached.join(F.broadcast(wanted), "pid").join(own, ["counted", "h", "u"], "left")  # wanted: at most BATCH rows
    got = rows.groupBy("rid").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("p")).collect()
    return dict.fromkeys(paths, (0, 0)) | {r["rid"]: (r["n"], r["p"]) for r in got}


def batch_body_sizes(spark: SparkSession, kb: DataFrame, rules: Sequence[Rule], variables=None) -> list[tuple[int, int]]:
    """Body size and PCA body size of each rule: bodies once, then those whose counted entity has any fact of the head's relation.
    ``variables`` gives the variables of a rule whose bindings count; by default those of its head."""
    out: dict[int, tuple[int, int]] = {i: (0, 0) for i in range(len(rules))}
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, r in enumerate(rules):
        number = {v: n for n, v in enumerate(variables_of(a for a in r.body if plain(a.r) != DIFFERENT))}
        kept = tuple(number[v] for v in (variables(r) if variables else r.head.variables))
        groups[shape_of(r.body), kept, number[r.counted_variable] if is_variable(r.counted_variable) else None, r.counted].append(i)
    domains = {0: kb.select("r", F.col("s").alias("e")).distinct(), 2: kb.select("r", F.col("o").alias("e")).distinct()}
    parts = []
    for (_, kept, at, counted), members in groups.items():
        for k in range(0, len(members), BATCH):
            part = members[k : k + BATCH]
            rows = batch_bindings(spark, kb, [(i, rules[i].body) for i in part], kept)
            heads = spark.createDataFrame([(i, rules[i].head.r, rules[i].head.s if counted == 0 else rules[i].head.o) for i in part], "rid long, r string, c string")
            entity = F.col(f"v{at}") if at is not None else F.col("c")
            domain = domains[counted].withColumn("known", F.lit(1))
            rows = rows.join(F.broadcast(heads), "rid").withColumn("e", entity).join(domain, ["r", "e"], "left")  # heads: at most BATCH rows
            parts.append(rows.groupBy("rid").agg(F.count("*").alias("n"), F.count("known").alias("p")))
    for row in collected(parts):
        out[row["rid"]] = row["n"], row["p"]
    return [out[i] for i in range(len(rules))]
