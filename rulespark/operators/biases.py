"""Further languages of rules. Those with a fixed pattern are one aggregation over all relations and types at once."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import replace
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from rulespark.functions.text import ratio
from rulespark.operators import schema as types_of
from rulespark.operators.metrics import BATCH, batch_bindings, batch_body_sizes, batch_supports, label, shape_of
from rulespark.operators.miner import Config, Miner
from rulespark.operators.pairs import Counts
from rulespark.operators.stats import own_labels, relation_sizes, summary
from rulespark.operators.storage import stored
from rulespark.plans.terms import DIFFERENT, TYPE, Atom, Rule, is_variable


def mine_one_variable(kb: DataFrame, config: Config = Config(), count_subject: bool = False) -> list[Rule]:
    """Support and confidence count the functional variable alone (always the subject with ``count_subject``)."""
    return Miner(kb, replace(config, one_variable=True, count_subject=count_subject)).mine()


def with_signature_types(kb: DataFrame, schema: DataFrame, rules: Sequence[Rule], min_pca: float = 0.0) -> list[Rule]:
    """Rules with the types of the head's domain and range in their bodies, recounted. Types are looked up among the facts of both."""
    known = {r["r"]: (r["domain"], r["range"]) for r in types_of.signatures(schema).collect()}  # a row per relation
    both = kb.select("s", "r", "o").union(schema.filter(F.col("r") == TYPE).select("s", "r", "o")).distinct()
    out = []
    for rule in rules:
        kinds = known.get(rule.head.r, (None, None))
        more = [Atom(v, TYPE, k) for v, k in zip((rule.head.s, rule.head.o), kinds) if k and is_variable(v)]
        if more:
            out.append(replace(rule.add(*more), parents=rule.parents))
    sizes = batch_body_sizes(kb.sparkSession, both, out)
    counted = [replace(r, support=s, body_size=n, pca_body_size=p) for r, s, (n, p) in zip(out, batch_supports(kb.sparkSession, both, out), sizes)]
    return [r for r in counted if (r.pca_confidence or 0) >= min_pca]


def _typed(schema: DataFrame) -> DataFrame:
    return types_of.materialised_types(schema)


def signature_rules(kb: DataFrame, schema: DataFrame, least: int = 100) -> DataFrame:
    """``type(x,C) & r(x,y) => type(y,D)``: ``r``, ``domain``, ``range``, ``support`` (objects), ``body_size`` (objects), ``std_confidence``."""
    t = _typed(schema)
    body = kb.join(t.select(F.col("e").alias("s"), F.col("type").alias("domain")), "s").select("r", "domain", F.col("o").alias("e")).distinct()
    hits = body.join(t.withColumnRenamed("type", "range"), "e").groupBy("r", "domain", "range").agg(F.count("*").alias("support")).filter(F.col("support") >= least)
    sizes = body.groupBy("r", "domain").agg(F.count("*").alias("body_size"))
    return hits.join(sizes, ["r", "domain"]).select("r", "domain", "range", "support", "body_size", ratio(F.col("support"), F.col("body_size")).alias("std_confidence"))


def existential_heads(kb: DataFrame, schema: DataFrame, least: int = 100) -> DataFrame:
    """``type(x,C) => r(x,.)`` and, ``negated``, ``type(x,C) => no r(x,.)``: support, body size, standard confidence. Pairs of type and relation
    without a common entity make negated rules too; there are as many rows as types times relations."""
    t = _typed(schema)
    sizes = t.groupBy("type").agg(F.count("*").alias("body_size"))
    has = kb.select("r", F.col("s").alias("e")).distinct().join(t, "e").groupBy("r", "type").agg(F.count("*").alias("n"))
    grid = sizes.join(F.broadcast(relation_sizes(kb).select("r")), F.lit(True)).join(has, ["r", "type"], "left").fillna(0, ["n"])  # a row per relation
    rows = grid.select("r", "type", "body_size", F.explode(F.array(F.struct(F.lit(False).alias("negated"), F.col("n").alias("support")), F.struct(F.lit(True).alias("negated"), (F.col("body_size") - F.col("n")).alias("support")))).alias("h"))
    rows = rows.select("type", F.col("h.negated").alias("negated"), "r", F.col("h.support").alias("support"), "body_size").filter(F.col("support") >= least)
    return rows.withColumn("std_confidence", ratio(F.col("support"), F.col("body_size")))


def open_rules(kb: DataFrame, config: Config = Config(max_atoms=2)) -> list[Rule]:
    """Rules that aren't closed, as "there is some value": head and one body atom sharing one variable, by PCA confidence."""
    miner = Miner(kb, replace(config, max_atoms=max(3, config.max_atoms), operators=("dangling",)))
    _, dangling = miner.extensions(miner.seeds())
    counts, out = miner.counts, []
    for r in dangling:
        if r.counted_variable in r.body[-1].variables:
            own, head = label(r.body[-1], r.counted_variable), r.head.r + ("+" if r.counted == 0 else "-")
            out.append(replace(r, support=counts.entities(own, head), body_size=counts.entities(own), pca_body_size=counts.entities(own)))
    return [r for r in out if (r.pca_confidence or 0) >= config.min_pca_confidence]


def completeness_rules(kb: DataFrame, truth: DataFrame, schema: DataFrame, least: int = 100, most_values: int | None = None) -> DataFrame:
    """Rules for an entity's being complete or incomplete in a relation, from what is known of some. ``truth``: ``e``, ``r``, ``complete``.
    Bodies: has more than n values of the relation, has fewer than n (n in steps of one up to the largest number of values that occurs, or
    to ``most_values``), is of a type, isn't, has some fact of another relation. ``confidence``: support over support and counter-evidence."""
    known = truth.select("e", F.col("r").alias("target"), "complete").distinct()
    deg = kb.groupBy(F.col("s").alias("e"), F.col("r").alias("target")).agg(F.count("*").alias("deg"))
    yes_no = [F.count(F.when(F.col("complete"), 1)).alias("yes"), F.count(F.when(~F.col("complete"), 1)).alias("no")]
    own = known.join(deg, ["e", "target"], "left").fillna(0, ["deg"]).groupBy("target", "deg").agg(*yes_no)  # steps are made of the histogram
    top = own.groupBy("target").agg(F.max("deg").alias("top") if most_values is None else F.lit(most_values).cast("long").alias("top"))
    steps = own.join(top, "target").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), "top")))
    counted = steps.filter("n <> deg").select("target", F.concat(F.when(F.col("n") < F.col("deg"), "hasNumberOfValuesGreaterThan").otherwise("hasNumberOfValuesSmallerThan"), F.col("n").cast("string")).alias("body"), "yes", "no")
    types = known.join(_typed(schema), "e").groupBy("target", "type").agg(*yes_no)
    typed = types.select("target", F.concat(F.lit("type "), "type").alias("body"), "yes", "no")
    untyped = types.join(known.groupBy("target").agg(*[c.alias(f"all_{n}") for c, n in zip(yes_no, ("yes", "no"))]), "target").select("target", F.concat(F.lit("not type "), "type").alias("body"), F.col("all_yes") - F.col("yes"), F.col("all_no") - F.col("no"))
    star = known.join(kb.select(F.col("s").alias("e"), "r").distinct(), "e").filter("r <> target").groupBy("target", "r").agg(*yes_no).select("target", F.concat(F.lit("exists "), "r").alias("body"), "yes", "no")
    rows = counted.union(typed).union(untyped).union(star).groupBy("target", "body").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    both = rows.select("target", "body", F.explode(F.array(F.struct(F.lit("isComplete").alias("head"), F.col("yes").alias("support"), F.col("no").alias("against")), F.struct(F.lit("isIncomplete").alias("head"), F.col("no").alias("support"), F.col("yes").alias("against")))).alias("h"))
    return both.select("target", "body", "h.*").filter(F.col("support") >= least).withColumn("confidence", ratio(F.col("support"), F.col("support") + F.col("against")))


def completeness_pairs(kb: DataFrame, truth: DataFrame, schema: DataFrame, least: int = 100) -> DataFrame:
    """Rules like :func:`completeness_rules` with two body atoms, a type and a fact of another relation: ``target``, ``type``, ``r``, ``head``, ``support``,
    ``against``, ``confidence``."""
    known = truth.select("e", F.col("r").alias("target"), "complete").distinct()
    rows = known.join(_typed(schema), "e").join(kb.select(F.col("s").alias("e"), "r").distinct(), "e").filter("r <> target")
    rows = rows.groupBy("target", "type", "r").agg(F.count(F.when(F.col("complete"), 1)).alias("yes"), F.count(F.when(~F.col("complete"), 1)).alias("no"))
    both = rows.select("target", "type", "r", F.explode(F.array(F.struct(F.lit("isComplete").alias("head"), F.col("yes").alias("support"), F.col("no").alias("against")), F.struct(F.lit("isIncomplete").alias("head"), F.col("no").alias("support"), F.col("yes").alias("against")))).alias("h"))
    return both.select("target", "type", "r", "h.*").filter(F.col("support") >= least).withColumn("confidence", ratio(F.col("support"), F.col("support") + F.col("against")))


def star_completeness_rules(kb: DataFrame, truth: DataFrame, schema: DataFrame, least: int = 100) -> DataFrame:
    """Of these the rules whose body is a fact of another relation."""
    return completeness_rules(kb, truth, schema, least).filter(F.col("body").startswith("exists "))


def seed_supports(kb: DataFrame, seeds: DataFrame, rules: Sequence[Rule]) -> list[int]:
    """Each rule's number of counted entities that are seeds (``e``); a job for each shape of rule."""
    out = dict.fromkeys(range(len(rules)), 0)
    groups: dict[tuple, list] = defaultdict(list)
    for i, r in enumerate(rules):
        groups[shape_of(r.atoms), r.variables.index(r.counted_variable)].append((i, r.atoms))
    wanted = seeds.select("e").distinct()
    for (_, at), members in groups.items():
        for k in range(0, len(members), BATCH):
            rows = batch_bindings(kb.sparkSession, kb, members[k : k + BATCH], [at]).withColumnRenamed(f"v{at}", "e")
            for row in rows.join(wanted, "e", "left_semi").groupBy("rid").agg(F.count("*").alias("n")).collect():
                out[row["rid"]] = row["n"]
    return [out[i] for i in range(len(rules))]


def typed_heads(kb: DataFrame, types: DataFrame, coverage: float = 0.01) -> DataFrame:
    """First refinements of ``=> r(x,y)`` by types (``e``, ``type``): ``r``, ``domain``, ``range``, ``support``: every pair of types and every type of the
    object alone (``domain`` null); of the subject alone (``range`` null) only in relations without any type of objects."""
    sizes = relation_sizes(kb).select("r", F.ceil(F.col("n") * coverage).alias("least"))
    domain, range_ = (types.select(F.col("e").alias(c), F.col("type").alias(t)).distinct() for c, t in (("s", "domain"), ("o", "range")))
    right = kb.join(range_, "o")
    pairs = right.join(domain, "s").groupBy("r", "domain", "range").agg(F.count("*").alias("support"))
    objects = right.groupBy("r", "range").agg(F.count("*").alias("support"))
    bare = relation_sizes(kb).select("r").join(objects.select("r").distinct(), "r", "left_anti")
    subjects = kb.join(bare, "r", "left_semi").join(domain, "s").groupBy("r", "domain").agg(F.count("*").alias("support"))
    none = F.lit(None).cast("string")
    rows = pairs.unionByName(objects.withColumn("domain", none)).unionByName(subjects.withColumn("range", none))
    return rows.join(sizes, "r").filter("support >= least").select("r", "domain", "range", "support")


def shared_type_pca(kb: DataFrame, types: DataFrame, rule: Rule) -> DataFrame:
    """One row ``pca_body_size``: pairs of the PCA body that have a type in common, or all of them if none has."""
    from rulespark.plans.bgp import compile_query, name
    from rulespark.plans.terms import pca_query

    x, y = map(name, rule.head.variables)
    rows = compile_query(kb, pca_query(rule), rule.head.variables)
    own = lambda c: types.select(F.col("e").alias(c), "type").distinct()
    alike = rows.join(own(x), x).join(own(y), [y, "type"]).select(x, y).distinct().withColumn("alike", F.lit(1))
    counts = rows.join(alike, [x, y], "left").agg(F.count("*").alias("all"), F.count("alike").alias("alike"))
    return counts.select(F.when(F.col("alike") > 0, F.col("alike")).otherwise(F.col("all")).alias("pca_body_size"))


def instantiated_head_rules(kb: DataFrame, least: int = 100) -> DataFrame:
    """``b(x,.) => r(x,C)`` (or with x and C, or the body's places, turned): ``r``, ``counted`` (x's side of the head), ``constant``, ``body``, ``side`` (x's
    side of the body), ``support``, ``body_size``, ``std_confidence``. The constant is on the side that isn't counted."""
    kb = stored(kb, "facts")
    own = stored(own_labels(kb).select("e", F.col("own.l").alias("set")), "entity-labels")
    sizes = own.groupBy("set").agg(F.count("*").alias("n"), F.count("e").alias("known")).select("n", "known", F.explode("set").alias("l")).groupBy("l").agg(F.sum("n").alias("body_size"), F.sum("known").alias("known"))
    sizes = stored(sizes.select(F.expr("left(l, length(l) - 1)").alias("body"), F.when(F.col("l").endswith("+"), "s").otherwise("o").alias("side"), "body_size", "known"), "label-sizes")
    sides = sizes.groupBy(F.col("body").alias("r")).agg((F.sum(F.when(F.col("side") == "s", F.col("known"))) >= F.sum(F.when(F.col("side") == "o", F.col("known")))).alias("by_subject"))
    x, c = (F.when(F.col("by_subject"), F.col(a)).otherwise(F.col(b)) for a, b in (("s", "o"), ("o", "s")))
    heads = kb.join(F.broadcast(sides), "r").select("r", F.when(F.col("by_subject"), "s").otherwise("o").alias("counted"), x.alias("e"), c.alias("constant"))  # sides: a row per relation
    # a rule's support is a part of its head's facts, so rare constants go with rare rules; facts meet their entity's set of labels, which is counted before it is taken apart
    by_set = heads.join(own, "e").groupBy("r", "counted", "constant", "set").agg(F.count("*").alias("n"))
    hits = by_set.select("r", "counted", "constant", "n", F.explode("set").alias("l")).select("r", "counted", "constant", "n", F.expr("left(l, length(l) - 1)").alias("body"), F.when(F.col("l").endswith("+"), "s").otherwise("o").alias("side"))
    found = hits.filter("not (r = body and counted = side)").groupBy("r", "counted", "constant", "body", "side").agg(F.sum("n").alias("support")).filter(F.col("support") >= least)
    return found.join(F.broadcast(sizes.drop("known")), ["body", "side"]).select("r", "counted", "constant", "body", "side", "support", "body_size", ratio(F.col("support"), F.col("body_size")).alias("std_confidence"))


def probabilistic_rules(kb: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule``, ``support``, ``pca_body``, ``pca_confidence`` over facts with probabilities ``p``."""
    from functools import reduce

    from rulespark.operators.predict import probabilistic_pca
    from rulespark.plans.terms import datalog_text

    parts = [probabilistic_pca(kb, r).select(F.lit(datalog_text(r)).alias("rule"), "support", "pca_body") for r in rules]
    return reduce(DataFrame.union, parts).withColumn("pca_confidence", ratio(F.col("support"), F.col("pca_body")))


def link_rules(kb: DataFrame, schema: DataFrame, link: str = "<linksTo>", least: int = 100) -> DataFrame:
    """``linksTo(x,y) & type(x,C) & type(y,D) => r(x,y)``: ``domain``, ``range``, ``r``, support, body size, PCA body size and confidence; PCA keeps
    the relation's functional side. Only relations that have entities in common with both sides of the links are compared with them."""
    t = _typed(schema)
    counts = Counts(kb)
    entities = lambda r, sign: counts.entities(r + sign, r + sign)
    worth = {r: entities(r, "+") >= entities(r, "-") for r in counts.known if r != link and counts.may_meet(link + "+", r + "+")}
    body = kb.filter(F.col("r") == link).select("s", "o").join(t.select(F.col("e").alias("s"), F.col("type").alias("domain")), "s").join(t.select(F.col("e").alias("o"), F.col("type").alias("range")), "o")
    body = stored(body, "typed-links")
    facts = kb.filter(F.col("r").isin(sorted(worth)))
    hits = stored(body.join(facts, ["s", "o"]).groupBy("domain", "range", "r").agg(F.count("*").alias("support")).filter(F.col("support") >= least), "link-hits")
    met = {r["r"] for r in hits.select("r").distinct().collect()}  # a row per relation
    sizes = body.groupBy("domain", "range").agg(F.count("*").alias("body_size"))
    parts = []
    for side, by_subject in (("s", True), ("o", False)):
        own = kb.filter(F.col("r").isin(sorted(r for r in met if worth[r] == by_subject))).select("r", side).distinct()
        ends = body.groupBy(side, "domain", "range").agg(F.count("*").alias("n"))
        parts.append(ends.join(own, side).groupBy("domain", "range", "r").agg(F.sum("n").alias("pca_body_size")))
    rows = hits.join(sizes, ["domain", "range"]).join(parts[0].union(parts[1]), ["domain", "range", "r"])
    return rows.select("domain", "range", "r", "support", "body_size", "pca_body_size", ratio(F.col("support"), F.col("pca_body_size")).alias("pca_confidence"))


def constant_rules(kb: DataFrame, config: Config = Config()) -> list[Rule]:
    """``b(x,D) => r(x,C)``: rules of two atoms about one variable, with a constant in both. In the head it is on the side that isn't counted, in the body on either. Entities meet the
    constants they share with enough others, never each other. A row per rule comes to the driver."""
    if config.prune_by != "headcoverage" or config.one_variable:
        raise ValueError("only head coverage prunes here")
    kb = stored(kb.select("s", "r", "o").distinct(), "constant-facts")
    stats_ = {r["r"]: r for r in summary(kb).collect()}  # a row per relation
    heads = [(r, "+" if row["subjects"] >= row["objects"] else "-", row["size"], max(2, math.ceil(config.min_head_coverage * row["size"]))) for r, row in stats_.items() if row["size"] >= config.min_head_size]
    edges = kb.select(F.concat("r", F.lit("+")).alias("l"), F.col("s").alias("x"), F.col("o").alias("c")).unionAll(kb.select(F.concat("r", F.lit("-")), "o", "s")).filter("x IS NOT NULL AND c IS NOT NULL")
    if not heads:
        return []
    sizes = edges.groupBy("l", "c").agg(F.count("*").alias("size")).filter(F.col("size") >= min(h[3] for h in heads))
    often = stored(edges.join(sizes, ["l", "c"]), "frequent-constants")
    wanted = kb.sparkSession.createDataFrame([(r + side, n, least) for r, side, n, least in heads], "h string, head_size long, least long")
    head = often.select(F.col("l").alias("h"), F.col("c").alias("hc"), "x", F.col("size").alias("head_n")).join(F.broadcast(wanted), "h").filter("head_n >= least")  # wanted: a row per relation
    rules = ["h", "hc", "l", "c"]
    found = head.join(often, "x").filter("NOT (h = l AND hc = c)").groupBy(*rules, "least", "head_size", "size").agg(F.count("*").alias("support")).filter("support >= least")
    found = stored(found, "constant-rules")
    known = edges.join(F.broadcast(wanted.select(F.col("h").alias("l"))), "l").select(F.col("l").alias("h"), "x").distinct()
    pairs = found.select("h", "l", "c").distinct()
    pca = often.join(pairs.select("l", "c").distinct(), ["l", "c"]).select("l", "c", "x").join(known, "x").groupBy("h", "l", "c").agg(F.count("*").alias("pca"))
    out = []
    for row in found.join(pca, ["h", "l", "c"]).collect():
        x = "?a" if row["h"][-1] == "+" else "?b"
        atom = lambda l, c: Atom(x, l[:-1], c) if l[-1] == "+" else Atom(c, l[:-1], x)
        if row["support"] >= config.min_pca_confidence * row["pca"]:
            other = (Atom(row["c"], DIFFERENT, row["hc"]),) if row["l"] == row["h"] else ()  # as the miner writes it
            out.append(Rule(atom(row["h"], row["hc"]), (atom(row["l"], row["c"]), *other), row["support"], row["head_size"], row["size"], row["pca"], counted=0 if row["h"][-1] == "+" else 2))
    return out


def keys(kb: DataFrame, relations: Sequence[str], most: int = 2) -> DataFrame:
    """``r(x,z) & r(y,z) & ... => x = y`` for sets of up to ``most`` relations: ``key``, ``support`` (subjects with a value for all that no
    other shares), ``subjects``, ``confidence``. A subject with several values has each combination of them."""
    parts = []
    for k in range(1, most + 1):
        for own in combinations(sorted(relations), k):
            rows = None
            for i, r in enumerate(own):
                one = kb.filter(F.col("r") == r).select("s", F.col("o").alias(f"o{i}"))
                rows = one if rows is None else rows.join(one, "s")
            shared = rows.groupBy(*[f"o{i}" for i in range(k)]).agg(F.count_distinct("s").alias("n"), F.min("s").alias("s"))
            alone = shared.filter("n = 1").select("s").distinct().agg(F.count("*").alias("support"))
            total = rows.agg(F.count_distinct("s").alias("subjects"))
            parts.append(alone.join(total, F.lit(True)).select(F.lit("+".join(own)).alias("key"), "support", "subjects", ratio(F.col("support"), F.col("subjects")).alias("confidence")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def conditional_keys(kb: DataFrame, key: str, condition: str, least: int = 10) -> DataFrame:
    """Where a relation is a key among the subjects with one value of another relation: ``condition``, ``support``, ``subjects``, ``confidence``."""
    rows = kb.filter(F.col("r") == key).select("s", F.col("o").alias("k")).join(kb.filter(F.col("r") == condition).select("s", F.col("o").alias("condition")), "s")
    alone = rows.groupBy("condition", "k").agg(F.count_distinct("s").alias("n"), F.min("s").alias("s")).filter("n = 1").groupBy("condition").agg(F.count_distinct("s").alias("support"))
    total = rows.groupBy("condition").agg(F.count_distinct("s").alias("subjects"))
    return total.join(alone, "condition", "left").fillna(0, ["support"]).filter(F.col("support") >= least).withColumn("confidence", ratio(F.col("support"), F.col("subjects")))


def specialised_types(schema: DataFrame, rule: Rule) -> list[Rule]:
    """The last type atom's type replaced by each direct subtype."""
    last = rule.body[-1]
    if last.r != TYPE or is_variable(last.o):
        return []
    return [rule.replace_last(Atom(last.s, TYPE, r["type"])) for r in types_of.sub_types(schema, last.o, transitive=False).orderBy("type").toLocalIterator()]


# --- estimates from statistics alone


def path_pca_estimate(rule: Rule, stats: dict[str, tuple[float, float, float, float]], overlap) -> float | None:
    """PCA confidence of a path rule of any length from sizes: support over the head's overlapping entities times the fan-outs on the way, each atom behind the
    first also times its inverse functionality, for pairs that several entities in between join. ``stats``: functionality, inverse functionality, subjects, objects; ``overlap(r1, side1, r2, side2)``: common entities."""
    from rulespark.plans.terms import canonical_path

    path = canonical_path(rule)
    if path is None or not path:
        return None
    at = rule.head.s
    sides = []
    for a in path:
        into = "s" if a.s == at else "o"
        at = a.o if into == "s" else a.s
        sides.append((a.r, into, "o" if into == "s" else "s"))
    pairs = overlap(rule.head.r, "s", sides[0][0], sides[0][1])
    for k, ((r, into, out), nxt) in enumerate(zip(sides, [*sides[1:], None])):
        pairs /= stats[r][0 if into == "s" else 1]
        if k:
            pairs *= stats[r][1 if into == "s" else 0]
        if nxt:
            size = stats[r][3 if out == "o" else 2]
            pairs *= overlap(r, out, nxt[0], nxt[1]) / size if size else 0
    return rule.support / pairs if pairs else None
