"""Predictions of rules, their evaluation, joint and iterated inference, probabilistic support."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Observation, Window, functions as F

from rulespark.functions.text import ratio
from rulespark.operators.stats import degrees, summary
from rulespark.operators.storage import stored
from rulespark.plans.bgp import compile_query, facts_packed, name, packed, tagged
from rulespark.plans.terms import Atom, Rule, is_variable, native_text, pca_query


def _facts(rows: DataFrame, head: Atom) -> DataFrame:
    value = lambda t: F.col(name(t)) if is_variable(t) else F.lit(t)
    return rows.select(value(head.s).alias("s"), F.lit(head.r).alias("r"), value(head.o).alias("o"))


def body_facts(kb: DataFrame, rule: Rule) -> DataFrame:
    """What the rule derives, known or not."""
    return _facts(compile_query(kb, rule.body, rule.head.variables), rule.head)


def _open(rule: Rule) -> bool:
    """Two variables in the head, and no inequalities or other filters in the body."""
    return len(set(rule.head.variables)) == 2 and is_variable(rule.head.s) and is_variable(rule.head.o) and not any(a.special for a in rule.body)


def _pairs(rows: DataFrame, relation: str, *more: F.Column) -> DataFrame:
    return rows.select(F.col("x").alias("s"), F.lit(relation).alias("r"), F.col("y").alias("o"), *more)


def predictions(kb: DataFrame, rule: Rule) -> DataFrame:
    """What the rule derives and the knowledge base lacks."""
    if _open(rule):
        rows = tagged([packed(kb, rule.body, rule.head.s, rule.head.o), facts_packed(kb, rule.head.r)])
        return _pairs(rows.filter("tags = 1"), rule.head.r)
    return body_facts(kb, rule).join(kb.filter(F.col("r") == rule.head.r), ["s", "r", "o"], "left_anti")


def pca_body_facts(kb: DataFrame, rule: Rule) -> DataFrame:
    return _facts(compile_query(kb, pca_query(rule), rule.head.variables), rule.head)


def assumed_false(kb: DataFrame, rule: Rule) -> DataFrame:
    """Derived facts whose counted entity has other values, which partial completeness takes for false."""
    return pca_body_facts(kb, rule).join(kb, ["s", "r", "o"], "left_anti")


def all_predictions(kb: DataFrame, rules: Sequence[Rule], known: bool = False) -> DataFrame:
    """``rule`` (number), ``s``, ``r``, ``o`` of all rules; subject and object differ."""
    parts = [(body_facts if known else predictions)(kb, rule).withColumn("rule", F.lit(i)) for i, rule in enumerate(rules)]
    return reduce(DataFrame.union, parts).filter("s <> o").select("rule", "s", "r", "o")


def sample_by_rule(found: DataFrame, n: int, across: bool = True, seed: str = "") -> DataFrame:
    """n predictions of each rule in the order of a hash; ``across``: a fact counts for its first rule alone."""
    if across:
        found = found.groupBy("s", "r", "o").agg(F.min("rule").alias("rule")).select("rule", "s", "r", "o")
    w = Window.partitionBy("rule").orderBy(F.md5(F.concat_ws("\t", F.lit(seed), "s", "r", "o")), "s", "r", "o")
    return found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")


def bucket_sample(scored: DataFrame, n: int, seed: str = "", first: str = "02") -> DataFrame:
    """Ten buckets by ``score``, the highest first; n of each in the order of a hash. Facts whose hash is below ``first`` are kept in one pass, which counts the buckets whole, too; where
    they are fewer than n of a bucket that has more, its facts are ordered as they are."""
    rows = scored.withColumn("bucket", F.greatest(F.lit(0), 9 - F.floor(F.col("score") * 10).cast("int"))).withColumn("_h", F.md5(F.concat_ws("\t", F.lit(seed), "s", "r", "o")))
    w = Window.partitionBy("bucket").orderBy("_h", "s", "r", "o")
    least = lambda df: df.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k", "_h")
    seen, whole = Observation(), [F.count(F.when(F.coalesce("bucket", F.lit(-1)) == b, 1)).alias(str(b)) for b in range(-1, 10)]
    low = stored(rows.observe(seen, *whole, F.count(F.when(~F.coalesce("bucket", F.lit(-1)).between(-1, 9), 1)).alias("out")).filter(F.col("_h") < first), "low-hashes")
    found = {r["bucket"]: r["n"] for r in low.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row per bucket
    total = seen.get
    short = [b for b in range(-1, 10) if found.get(None if b < 0 else b, 0) < min(n, total[str(b)])]
    if total["out"]:
        return least(rows)
    among = F.coalesce("bucket", F.lit(-1)).isin(short)
    out = least(low.filter(~among))
    return out.unionAll(least(rows.filter(among))) if short else out


# --- evaluation


def _gates(kb: DataFrame, fun: float, ifun: float, relations: Sequence[str] | None) -> dict[str, set[str]]:
    """Functional relations by ``s`` and inversely functional ones by ``o``; a row per relation."""
    part = kb if relations is None else kb.filter(F.col("r").isin(list(relations)))
    rows = summary(part).select("r", "functionality", "inverse_functionality").collect()
    return {"s": {r["r"] for r in rows if (r["functionality"] or 0) >= fun}, "o": {r["r"] for r in rows if (r["inverse_functionality"] or 0) >= ifun}}


def _ruled(rows: DataFrame, columns: Sequence[str], training: DataFrame, target: DataFrame, gates: dict[str, dict[str, set[str]]]) -> DataFrame:
    """Verdicts of rows with ``hit``. Only entities of gated relations are looked up; where there is no such relation, no join is made."""
    for k, kb in (("training", training), ("target", target)):
        for side in "so":
            if gates[k][side]:
                used = kb.filter(F.col("r").isin(sorted(gates[k][side]))).select("r", side).distinct().withColumn(f"{k}_{side}", F.lit(True))
                rows = rows.join(used, ["r", side], "left")
            else:
                rows = rows.withColumn(f"{k}_{side}", F.lit(False))
    no = lambda k: F.coalesce(F.col(f"{k}_s"), F.col(f"{k}_o"), F.lit(False))
    hit = F.coalesce("hit", F.lit(False))
    return rows.select(
        *columns,
        F.when(hit, "True").when(no("training") | no("target"), "False").otherwise("Unknown").alias("verdict"),
        F.when(hit, "TargetSource").when(no("training"), "TrainingSource").when(no("target"), "TargetSource").otherwise("Undefined").alias("source"),
    )


def evaluate(facts: DataFrame, training: DataFrame, target: DataFrame, fun: float = 0.9, ifun: float = 0.84, relations: Sequence[str] | None = None) -> DataFrame:
    """``verdict``: True if the target has the fact; False if it contradicts a functional (or inversely functional) relation in training or
    target, ``source`` telling which; else Unknown. ``relations``: those of the facts, if known; no others are read then."""
    if relations is not None:
        training, target = (kb.filter(F.col("r").isin(list(relations))) for kb in (training, target))
    rows = facts.join(target.select("s", "r", "o").withColumn("hit", F.lit(True)), ["s", "r", "o"], "left")
    return _ruled(rows, facts.columns, training, target, {"training": _gates(training, fun, ifun, None), "target": _gates(target, fun, ifun, None)})


def judged(training: DataFrame, target: DataFrame, rules: Sequence[Rule], fun: float = 0.9, ifun: float = 0.84) -> list[DataFrame]:
    """``rule``, ``s``, ``r``, ``o``, ``verdict``, ``source``: predictions of all rules from the training facts as :func:`evaluate` judges them, a frame for each head
    relation. Bodies, training and target facts of a relation meet by subject, so pairs are shuffled once for all rules."""
    heads = sorted({r.head.r for r in rules})
    if not all(map(_open, rules)):
        found = evaluate(all_predictions(training, rules), training, target, fun, ifun, heads)
        return [found.filter(F.col("r") == h) for h in heads]
    gates = {"training": _gates(training, fun, ifun, heads), "target": _gates(target, fun, ifun, heads)}
    out = []
    for h in heads:
        own = [(i, r) for i, r in enumerate(rules) if r.head.r == h]
        for k in range(0, len(own), 60):  # bits of a number
            part = own[k : k + 60]
            old, new = 1 << len(part), 2 << len(part)
            rows = tagged([*[packed(training, r.body, r.head.s, r.head.o) for _, r in part], facts_packed(training, h), facts_packed(target, h).filter("x IS NOT NULL AND ys[0] IS NOT NULL")])
            rows = rows.filter((F.col("tags").bitwiseAND(old) == 0) & (F.col("tags").bitwiseAND(old - 1) > 0) & (F.col("x") != F.col("y")))
            by = F.filter(F.array(*[F.when(F.col("tags").bitwiseAND(1 << b) > 0, F.lit(i)) for b, (i, _) in enumerate(part)]), lambda v: v.isNotNull())
            rows = _pairs(rows, h, F.explode(by).alias("rule"), (F.col("tags").bitwiseAND(new) > 0).alias("hit"))
            own_gates = {k: {side: names & {h} for side, names in g.items()} for k, g in gates.items()}
            out.append(_ruled(rows, ["rule", "s", "r", "o"], training, target, own_gates))
    return out


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    one = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v.lower()}")
    return evaluated.groupBy("rule").agg(one("True"), one("False"), one("Unknown"))


def rule_hits(found: DataFrame, training: DataFrame, target: DataFrame) -> DataFrame:
    """For each rule: derived facts (known ones too), those in target, in training, in target but not training, raw and as the only rule's."""
    fact = ["s", "r", "o"]
    only = found.groupBy(*fact).agg(F.count("*").alias("rules"))
    rows = found.join(only, fact).join(training.select(*fact).withColumn("tr", F.lit(1)), fact, "left").join(target.select(*fact).withColumn("ta", F.lit(1)), fact, "left")
    new = F.col("ta").isNotNull() & F.col("tr").isNull()
    return rows.groupBy("rule").agg(
        F.count("*").alias("n"),
        F.count("ta").alias("in_target"),
        F.count("tr").alias("in_training"),
        F.count(F.when(new, 1)).alias("in_target_only"),
        F.count(F.when(F.col("ta").isNotNull() & (F.col("rules") == 1), 1)).alias("in_target_unique"),
        F.count(F.when(new & (F.col("rules") == 1), 1)).alias("in_target_only_unique"),
    )


def rule_body_report(found: DataFrame) -> DataFrame:
    """For each rule: predictions, those that no rule before it has, subjects, objects."""
    w = Window.partitionBy("s", "r", "o").orderBy("rule")
    rows = found.withColumn("k", F.row_number().over(w))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.count(F.when(F.col("k") == 1, 1)).alias("n_new"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


def override(found: DataFrame, evaluated: DataFrame, relations: Sequence[str] | None = None) -> DataFrame:
    """Verdicts of earlier evaluations (by fact; of several the least) in place of those there are. ``relations``: those of the evaluations, if known; other facts stay
    as they are without a join."""
    if relations is not None:
        among = F.coalesce(F.col("r").isin(list(relations)), F.lit(False))
        return override(found.filter(among), evaluated).unionByName(found.filter(~among))
    old = evaluated.groupBy("s", "r", "o").agg(F.min("verdict").alias("_v"))
    return found.join(old, ["s", "r", "o"], "left").withColumn("verdict", F.coalesce("_v", "verdict")).drop("_v").select(*found.columns)


def merge_evaluations(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).orderBy("rule")


def join_rules(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Two rule reports by ``rule`` text, or by canonical key where that column is."""
    on = "key" if "key" in a.columns and "key" in b.columns else "rule"
    return a.join(b.select(on, *[F.col(c).alias(f"{c}_2") for c in b.columns if c not in (on, "rule")]), on, how)


def rules_per_fact(*evaluated: DataFrame) -> DataFrame:
    """How many facts of each verdict so many rules derive. No fact is in two of the frames."""
    facts = [e.groupBy("s", "r", "o", "verdict").agg(F.count_distinct("rule").alias("rules")).select("rules", "verdict") for e in evaluated]
    return reduce(DataFrame.unionAll, facts).groupBy("rules", "verdict").agg(F.count("*").alias("n"))


def split_evaluated(evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with a verdict, and those that are left to people."""
    return evaluated.filter(F.col("verdict") != "Unknown"), evaluated.filter(F.col("verdict") == "Unknown")


def rank_rules(rules: DataFrame) -> DataFrame:
    """``rank`` by PCA confidence, then support, both ascending, then a hash of the text."""
    w = Window.orderBy("pca_confidence", "support", F.md5("rule"))
    return rules.withColumn("rank", F.row_number().over(w))  # a row per rule


def top_predictions(scored: DataFrame, score: str, n: int) -> DataFrame:
    """The n predictions of the highest score, among equals by name."""
    return scored.orderBy(F.desc(score), "s", "r", "o").limit(n)


_LEGACY = {"Y": "True", "N": "False"}


def legacy_evaluations(lines: Sequence[str], most: int = 30) -> list[tuple[str, str, str, str, str]]:
    """Evaluations of an old report: a rule's line, then its facts as verdict (Y, N or ?), a tab and ``s/r/o``; ``most`` facts of a rule."""
    from rulespark.plans.terms import parse_atoms

    out, rule, taken = [], None, 0
    for line in lines:
        cells = line.split("\t", 1)
        fact = cells[1].split("/") if len(cells) == 2 else []
        if len(fact) == 3 and cells[0] in ("Y", "N", "?"):
            if rule is not None and taken < most:
                out.append((rule, *fact, _LEGACY.get(cells[0], "Unknown")))
                taken += 1
        elif len(atoms := parse_atoms(line.split("Key variable:")[0])) >= 2:
            rule, taken = native_text(Rule(atoms[-1], tuple(atoms[:-1]))), 0
    return out


# --- joint predictions


def joint_predictions(found: DataFrame, confidences: DataFrame) -> DataFrame:
    """``s``, ``r``, ``o``, ``rules``, ``naive``: facts with all rules that derive them and 1 - the product of (1 - confidence). ``confidences``:
    ``rule``, ``confidence``. The product is taken over sorted values, so it doesn't depend on the order of rows."""
    rows = found.join(confidences, "rule").groupBy("s", "r", "o").agg(F.array_sort(F.collect_list("rule")).alias("rules"), F.array_sort(F.collect_list("confidence")).alias("c"))
    return rows.select("s", "r", "o", "rules", (1 - F.aggregate("c", F.lit(1.0), lambda acc, x: acc * (1 - x))).alias("naive"))


def joint_from_rules(kb: DataFrame, rules: Sequence[Rule], confidences: Sequence[float]) -> DataFrame:
    """As :func:`joint_predictions` of what all rules derive, known or not. Pairs of a head relation go to their subject once, as lists; what depends on a fact's set of rules alone is made of
    that."""
    out = []
    for h in sorted({r.head.r for r in rules}):
        own = [(i, r) for i, r in enumerate(rules) if r.head.r == h]
        if len(own) > 60 or not all(_open(r) for _, r in own):
            found = reduce(DataFrame.unionAll, [body_facts(kb, r).withColumn("rule", F.lit(i)) for i, r in own]).filter("s <> o")
            weights = kb.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(confidences)], "rule int, confidence double")
            out.append(joint_predictions(found, weights))
            continue
        rows = tagged([packed(kb, r.body, r.head.s, r.head.o) for _, r in own]).filter("x <> y")
        has = lambda b: F.col("tags").bitwiseAND(1 << b) > 0
        those = F.filter(F.array(*[F.when(has(b), F.lit(i)) for b, (i, _) in enumerate(own)]), lambda v: v.isNotNull())
        order = sorted(range(len(own)), key=lambda b: confidences[own[b][0]])
        rest = reduce(lambda acc, b: acc * F.when(has(b), 1 - F.lit(float(confidences[own[b][0]]))).otherwise(1.0), order, F.lit(1.0))
        out.append(_pairs(rows, h, those.alias("rules"), (1 - rest).alias("naive")))
    return reduce(DataFrame.unionAll, out)


def unlinked(found: DataFrame, kb: DataFrame, link: str = "<linksTo>") -> DataFrame:
    """Predictions between pairs that no relation but the link joins."""
    return found.join(kb.filter(F.col("r") != link).select("s", "o").distinct(), ["s", "o"], "left_anti").select(*found.columns)


def _middles(rule: Rule) -> list[tuple[str, str]] | None:
    """Of a body x - z - y: relation and side of x in the one atom, and of y in the other; None for other rules."""
    x, y = rule.head.s, rule.head.o
    if not _open(rule) or len(rule.body) != 2 or any(is_variable(a.r) or len(set(a.variables)) != 2 for a in rule.body):
        return None
    for one, two in (rule.body, rule.body[::-1]):
        if x in one.variables and y in two.variables and set(one.variables) - {x} == set(two.variables) - {y}:
            return [(one.r, "s" if one.s == x else "o"), (two.r, "s" if two.s == y else "o")]
    return None


def _wide(kb: DataFrame, rules: Sequence[Rule]) -> dict[int, list[tuple[str, str]]]:
    """Path rules whose ends have one middle at most: they derive (x, y) just if the two middles are one, a product by middle that can be counted without making it."""
    found = {i: m for i, m in enumerate(map(_middles, rules)) if m}
    sides = {m for ms in found.values() for m in ms}
    parts = [kb.filter(F.col("r").isin(sorted(r for r, c in sides if c == side))).select(F.lit(side).alias("c"), "r", F.col(side).alias("e")) for side in "so" if any(c == side for _, c in sides)]
    if not parts:
        return {}
    degrees = reduce(DataFrame.unionAll, parts).filter("e IS NOT NULL").groupBy("c", "r", "e").agg(F.count("*").alias("n"))
    single = {(r["r"], r["c"]) for r in degrees.groupBy("c", "r").agg(F.max("n").alias("n")).collect() if r["n"] == 1}  # a row per relation and side
    return {i: ms for i, ms in found.items() if all(m in single for m in ms)}


#: Between an entity's name and the numbers of its middles.
_MARK = "\x01"


def _middles_of(kb: DataFrame, wide: Sequence[list[tuple[str, str]]]) -> DataFrame:
    """``e``, ``m``: the numbers of an entity's middles, as x and as y of each rule."""
    sides = [m for ms in wide for m in ms]
    parts = [kb.filter(F.col("r") == r).select(F.col(c).alias("e"), F.col("o" if c == "s" else "s").alias("z"), F.lit(i).alias("i")) for i, (r, c) in enumerate(sides)]
    rows = reduce(DataFrame.unionAll, parts).filter("e IS NOT NULL AND z IS NOT NULL")
    numbers = stored(rows.select("z").distinct().withColumn("n", F.monotonically_increasing_id()), "middles")
    each = [F.max(F.when(F.col("i") == i, F.col("n"))).alias(f"m{i}") for i in range(len(sides))]
    return stored(rows.join(numbers, "z").groupBy("e").agg(*each).select("e", F.array(*[f"m{i}" for i in range(len(sides))]).alias("m")), "middles-of")


def _marked(kb: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """The facts with all middles' numbers put behind the entities' names, so that pairs bring them along."""
    text = own.select("e", F.concat_ws(",", *[F.coalesce(F.col("m")[i].cast("string"), F.lit("-")) for i in range(n)]).alias("text"))
    for c in "so":
        kb = kb.join(text.withColumnRenamed("e", c), c, "left").withColumn(c, F.concat(c, F.lit(_MARK), F.coalesce("text", F.lit("")))).drop("text")
    return kb.select("s", "r", "o")


def _counted_sets(kb: DataFrame, rules: Sequence[tuple[int, Rule]], wide: dict[int, list[tuple[str, str]]]) -> DataFrame:
    """``rules``, ``support``, ``n``, ``by_s``, ``by_o``, ``shown``: what :func:`_open` rules of one head relation derive, by set of rules. Pairs go to x once, as lists, with known
    facts and a mark of known subjects. At pairs that are there, wide rules are looked up in the middles behind the names; the rest of theirs is counted by middle."""
    h = rules[0][1].head.r
    named, products = [(i, r) for i, r in rules if i not in wide], [(i, wide[i]) for i, _ in rules if i in wide]
    if any(not is_variable(t) for _, r in named for a in r.body for t in (a.s, a.o)):
        named, products = list(rules), []
    by_s, by_o = any(r.counted == 0 for _, r in rules), any(r.counted != 0 for _, r in rules)
    facts = kb
    if not any(is_variable(a.r) for _, r in named for a in r.body):
        facts = kb.filter(F.col("r").isin(sorted({h, *(a.r for _, r in named for a in r.body)})))
    bits = {i: b for b, (i, _) in enumerate([*named, *products])}
    if products:
        own = _middles_of(kb, [m for _, m in products])
        facts = _marked(facts, own, 2 * len(products))
    heads = facts.filter(F.col("r") == h)
    hit = 1 << len(rules)
    no, yes = F.lit(False).alias("known"), F.lit(True).alias("known")
    frames = [packed(facts, r.body, r.head.s, r.head.o).select("x", "ys", F.lit(1 << bits[i]).cast("long").alias("tag"), no) for i, r in named]
    frames.append(facts_packed(facts, h).filter("x IS NOT NULL AND ys[0] IS NOT NULL").select("x", "ys", F.lit(hit).cast("long").alias("tag"), no))
    if by_s:
        frames.append(heads.select(F.col("s").alias("x"), F.array().cast("array<string>").alias("ys"), F.lit(0).cast("long").alias("tag"), yes).filter("x IS NOT NULL").distinct())
    rows = reduce(DataFrame.unionAll, frames).repartition("x")
    if by_s:
        rows = rows.withColumn("known", F.max("known").over(Window.partitionBy("x")))
    pairs = rows.select("x", F.explode("ys").alias("y"), "tag", "known").groupBy("x", "y").agg(F.bit_or("tag").alias("tags"), F.max("known").alias("known"))
    equal = lambda at, k, x, y: F.when(at(x, 2 * k) == at(y, 2 * k + 1), F.lit(1 << bits[products[k][0]])).otherwise(F.lit(0)).cast("long")
    mask = lambda at, x, y: reduce(lambda a, b: a + b, [equal(at, k, x, y) for k in range(len(products))])
    if products:
        read = lambda c: F.split(F.substring_index(c, _MARK, -1), ",")
        at = lambda c, j: F.nullif(F.get(c, j), F.lit("-"))
        pairs = pairs.withColumns({"mx": read("x"), "my": read("y")}).withColumn("tags", F.col("tags") + mask(at, F.col("mx"), F.col("my")))
    ones = [F.count("*").alias("n"), F.count(F.when(F.col("known"), 1)).alias("by_s"), F.count(F.when(F.col("x") != F.col("y"), 1)).alias("off")]
    if by_o:  # by y first: its pairs are one row for each set of rules
        objects = heads.select(F.col("o").alias("y"), F.lit(1).alias("in_o")).filter("y IS NOT NULL").distinct()
        counts = pairs.groupBy("y", "tags").agg(*ones).join(objects, "y", "left").withColumn("by_o", F.when(F.col("in_o") == 1, F.col("n")).otherwise(0))
        counts = counts.groupBy("tags").agg(*[F.sum(c).alias(c) for c in ("n", "by_s", "off", "by_o")])
    else:
        counts = pairs.groupBy("tags").agg(*ones).withColumn("by_o", F.lit(0).cast("long"))
    sums = ["n", "by_s", "by_o", "off"]
    counts = stored(counts.select("tags", *sums), "tag-sets")
    every = counts.select("tags", F.when(F.col("tags").bitwiseAND(hit) > 0, F.col("n")).otherwise(0).alias("support"), *sums)
    if products:
        # by the middles of x and those of y: entities, and of these known ones; a pair counts at the first rule it meets
        raw = kb.filter(F.col("r") == h)
        near = own
        for c in "so":
            near = near.join(raw.select(F.col(c).alias("e"), F.lit(True).alias(f"in_{c}")).filter("e IS NOT NULL").distinct(), "e", "left").fillna(False, [f"in_{c}"])
        ends = {c: near.groupBy(F.col("m").alias(f"m{c}"), F.col(f"in_{k}").alias(f"in_{c}")).agg(F.count("*").alias(f"n{c}")) for c, k in (("x", "s"), ("y", "o"))}
        direct = lambda c, j: c[j]
        totals = []
        for k in range(len(products)):
            met = ends["x"].withColumn("z", F.col("mx")[2 * k]).join(ends["y"].withColumn("z", F.col("my")[2 * k + 1]), "z").withColumn("tags", mask(direct, F.col("mx"), F.col("my")))
            met = met.filter(F.col("tags").bitwiseAND((1 << bits[products[k][0]]) - 1) == 0).withColumn("n", F.col("nx") * F.col("ny"))
            totals.append(met.select("tags", "n", F.when(F.col("in_x"), F.col("n")).otherwise(0).alias("by_s"), F.when(F.col("in_y"), F.col("n")).otherwise(0).alias("by_o"), F.col("n").alias("off")))
        zero = F.lit(0).cast("long")
        totals.append(own.select(mask(direct, F.col("m"), F.col("m")).alias("tags"), zero, zero, zero, F.lit(-1).cast("long")))
        all_ = sum(1 << bits[i] for i, _ in products)
        totals.append(counts.select(F.col("tags").bitwiseAND(all_), *[-F.col(c) for c in sums]))
        rest = reduce(DataFrame.unionAll, totals).filter("tags > 0").groupBy("tags").agg(*[F.sum(c).alias(c) for c in sums]).filter("n > 0")
        every = every.unionAll(rest.select("tags", zero.alias("support"), *sums))
    those = F.filter(F.array(*[F.when(F.col("tags").bitwiseAND(1 << bits[i]) > 0, F.lit(i)) for i in sorted(bits)]), lambda v: v.isNotNull())
    every = every.withColumn("rules", those).filter(F.size("rules") > 0).groupBy("rules").agg(*[F.sum(c).alias(c) for c in ("support", *sums)])
    return every.select("rules", "support", "n", "by_s", "by_o", (F.col("off") > 0).alias("shown"))


def joint_counts(kb: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rules`` (sorted numbers), ``support``, ``body_size``, ``pca_body_size`` of the combined rule of each set of rules that derives some fact together. Each derived fact
    has the set of all its rules; facts are counted by set, and a set's counts are the sums over the sets that contain it. That is a fixed number
    of jobs for a head relation, however many rules and sets there are."""
    spark = kb.sparkSession
    wide = _wide(kb, rules)
    parts, other = [], []
    for h in sorted({r.head.r for r in rules}):
        own = [(i, r) for i, r in enumerate(rules) if r.head.r == h]
        if len(own) <= 60 and all(_open(r) for _, r in own):  # bits of a number
            parts.append(_counted_sets(kb, own, {i: wide[i] for i, _ in own if i in wide}))
        else:
            other += own
    if other:
        facts = reduce(DataFrame.unionAll, [body_facts(kb, rule).withColumn("rule", F.lit(i)) for i, rule in other]).groupBy("s", "r", "o").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
        known = kb.select("s", "r", "o").distinct().withColumn("hit", F.lit(1))
        subjects, objects = kb.select("s", "r").distinct().withColumn("in_s", F.lit(1)), kb.select("o", "r").distinct().withColumn("in_o", F.lit(1))
        rows = facts.join(known, ["s", "r", "o"], "left").join(subjects, ["s", "r"], "left").join(objects, ["o", "r"], "left")
        parts.append(rows.groupBy("rules").agg(F.count("hit").alias("support"), F.count("*").alias("n"), F.count("in_s").alias("by_s"), F.count("in_o").alias("by_o"), F.max(F.col("s") != F.col("o")).alias("shown")))
    sets = stored(reduce(DataFrame.unionAll, parts), "rule-sets")
    counted = spark.createDataFrame([(i, r.counted == 0) for i, r in enumerate(rules)], "first int, by_subject boolean")  # a row per rule
    wanted = sets.filter("shown").select("rules", F.element_at("rules", 1).alias("first"))
    around = sets.select(F.col("rules").alias("larger"), "support", "n", "by_s", "by_o", F.explode("rules").alias("first"))
    hits = wanted.join(around, "first").filter(F.size(F.array_except("rules", "larger")) == 0).join(counted, "first")
    pca = F.when(F.col("by_subject"), F.col("by_s")).otherwise(F.col("by_o"))
    return hits.groupBy("rules").agg(F.sum("support").alias("support"), F.sum("n").alias("body_size"), F.sum(pca).alias("pca_body_size"))


def joint_confidence(kb: DataFrame, rules: Sequence[Rule]) -> dict[tuple[int, ...], float | None]:
    """PCA confidence of the combined rule for each set of rules that derives some fact together; a row per set comes to the driver. See :func:`joint_counts`."""
    return {tuple(r["rules"]): (r["support"] / r["pca_body_size"] if r["pca_body_size"] else None) for r in joint_counts(kb, rules).collect()}


def cardinality_scores(kb: DataFrame, facts: DataFrame) -> DataFrame:
    """``score``: the share of the relation's subjects with more objects than the fact's subject has so far."""
    have = degrees(kb, "s")
    hist = have.groupBy("r", "deg").agg(F.count("*").alias("n"))
    total = hist.groupBy("r").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("r").orderBy("deg")
    tail = hist.join(total, "r").select("r", "deg", ratio(F.col("total") - F.sum("n").over(w), F.col("total")).alias("score"))
    rows = facts.join(have.withColumnRenamed("e", "s"), ["r", "s"], "left").join(tail, ["r", "deg"], "left")
    return rows.select(*facts.columns, F.coalesce("score", F.lit(1.0)).alias("score"))


def iterate(kb: DataFrame, mine, threshold: float, rounds: int | None = None) -> DataFrame:
    """Mine, predict, add facts whose naive confidence is at least the threshold, and again, until nothing is added or the rounds asked for are over. ``mine``
    gives rules, of any language, of a knowledge base; :mod:`rulespark.operators.inference` is for rules of two atoms, at the cost of what is new alone.
    Facts with ``p`` (1 for the given ones) and ``iteration``."""
    known = kb.select("s", "r", "o").withColumn("p", F.lit(1.0)).withColumn("iteration", F.lit(0))
    for i in count(1) if rounds is None else range(1, rounds + 1):
        facts = known.select("s", "r", "o")
        rules = mine(facts)
        if not rules:
            break
        confidences = kb.sparkSession.createDataFrame([(k, r.pca_confidence or 0.0) for k, r in enumerate(rules)], "rule int, confidence double")
        new = joint_predictions(all_predictions(facts, rules), confidences).filter(F.col("naive") >= threshold)
        new = stored(new.select("s", "r", "o", F.col("naive").alias("p"), F.lit(i).alias("iteration")), "inferred")
        if new.isEmpty():
            break
        known = stored(known.union(new), "known")
    return known


# --- probabilistic facts


def _with_probability(kb: DataFrame, atoms: Sequence[Atom]) -> DataFrame:
    """All bindings of the atoms' variables with the product of their facts' probabilities."""
    rows = None
    for atom in atoms:
        conditions = [F.col(c) == F.lit(t) for c, t in zip("sro", atom.terms) if not is_variable(t)]
        own = kb.filter(reduce(lambda a, b: a & b, conditions)) if conditions else kb
        if is_variable(atom.s) and atom.s == atom.o:
            own = own.filter("s = o")
        own = own.select(*{t: F.col(c).alias(name(t)) for c, t in zip("sro", atom.terms) if is_variable(t)}.values(), F.col("p").alias("_p"))
        if rows is None:
            rows = own
        else:
            on = [c for c in own.columns if c in rows.columns and c != "_p"]
            rows = rows.withColumnRenamed("_p", "_q").join(own, on).withColumn("_p", F.col("_p") * F.col("_q")).drop("_q")
    return rows


def _or(p: F.Column) -> F.Column:
    """Probability that one of independent events happens, by sums of logarithms; 1 if one is certain."""
    return F.when(F.max(p) >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.when(p < 1, p).otherwise(0.0)))))


def body_probabilities(kb: DataFrame, rule: Rule) -> DataFrame:
    """``s``, ``o``, ``p`` of what the rule derives."""
    keys = [name(v) for v in rule.head.variables]
    rows = _with_probability(kb, rule.body).groupBy(*keys).agg(_or(F.col("_p")).alias("p"))
    value = lambda t: F.col(name(t)) if is_variable(t) else F.lit(t)
    return rows.select(value(rule.head.s).alias("s"), value(rule.head.o).alias("o"), "p")


def probabilistic_support(kb: DataFrame, rule: Rule) -> DataFrame:
    """One row ``support``: the sum of head probability times the probability of some body binding."""
    heads = kb.filter(F.col("r") == rule.head.r).select("s", "o", F.col("p").alias("h"))
    return body_probabilities(kb, rule).join(heads, ["s", "o"]).agg(F.sum(F.col("h") * F.col("p")).alias("support"))


def probabilistic_pca(kb: DataFrame, rule: Rule) -> DataFrame:
    """One row ``support``, ``pca_body``: the denominator sums body probability times that of the counted entity's having any value."""
    side = "s" if rule.counted == 0 else "o"
    some = kb.filter(F.col("r") == rule.head.r).groupBy(side).agg(_or(F.col("p")).alias("some"))
    body = body_probabilities(kb, rule).join(some, side).agg(F.sum(F.col("p") * F.col("some")).alias("pca_body"))
    return probabilistic_support(kb, rule).join(body, F.lit(True))


# --- two rules


def rule_overlap(kb: DataFrame, a: Rule, b: Rule) -> DataFrame:
    """One row: facts that both derive, either derives, and how many of each are known."""
    fact = ["s", "r", "o"]
    if a.head.r == b.head.r and _open(a) and _open(b):
        rows = tagged([*[packed(kb, r.body, r.head.s, r.head.o) for r in (a, b)], facts_packed(kb, a.head.r).filter("x IS NOT NULL AND ys[0] IS NOT NULL")]).filter("tags & 3 > 0")
        those = lambda test: F.count(F.when(F.expr(test), 1))
        return rows.agg(those("tags & 3 = 3").alias("both"), F.count("*").alias("either"), those("tags = 7").alias("both_known"), those("tags & 4 = 4").alias("either_known"))
    rows = body_facts(kb, a).withColumn("a", F.lit(1)).join(body_facts(kb, b).withColumn("b", F.lit(1)), fact, "full").join(kb.filter(F.col("r").isin(a.head.r, b.head.r)).select(*fact).withColumn("k", F.lit(1)), fact, "left")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return rows.agg(F.count(F.when(both, 1)).alias("both"), F.count("*").alias("either"), F.count(F.when(both & F.col("k").isNotNull(), 1)).alias("both_known"), F.count("k").alias("either_known"))


def confidence_gain(special: Sequence[Rule], general: Sequence[Rule], relation: str = "<linksTo>") -> list[tuple[str, str, float]]:
    """Special rules, each with the general rule that it is without its atoms of the relation, and the gain in PCA confidence."""
    known = {r.key: r for r in general}
    out = []
    for r in special:
        less = Rule(r.head, tuple(a for a in r.body if a.r != relation))
        if len(less.body) < len(r.body) and (g := known.get(less.key)):
            out.append((native_text(r), native_text(g), (r.pca_confidence or 0) - (g.pca_confidence or 0)))
    return out
