"""Set operations and filters on knowledge bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rulespark.operators.stats import occurrences, relation_sizes, summary
from rulespark.operators.storage import stored

FACT = ["s", "r", "o"]


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*FACT).intersect(b.select(*FACT))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*FACT).union(b.select(*FACT)).distinct()


def new_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Facts of b that a lacks."""
    return b.select(*FACT).distinct().join(a, FACT, "left_anti")


def without(a: DataFrame, gone: DataFrame) -> DataFrame:
    return a.select(*FACT).join(gone, FACT, "left_anti")


def coalesce(a: DataFrame, b: DataFrame, with_objects: bool = False) -> DataFrame:
    """Facts of both whose subject is an entity of a and a subject of b; with ``with_objects`` also b's facts of its other objects."""
    a, b = stored(a.select(*FACT), "coalesced-a"), stored(b.select(*FACT), "coalesced-b")  # each is derived once
    marked = lambda rows, mark: rows.withColumn("mark", F.lit(mark))  # noqa: E731  1: a's fact, 2: b's fact, 4: a's object
    objects = a.select(F.col("o").alias("s")).distinct().select("s", F.lit(None).cast("string").alias("r"), F.lit(None).cast("string").alias("o"))
    rows = marked(a, 1).unionAll(marked(b, 2)).unionAll(marked(objects, 4)).filter("s IS NOT NULL").repartition("s")
    # facts go to their subject once: there is the subject known, and there repeated facts meet
    rows = rows.groupBy(*FACT).agg(F.bit_or("mark").alias("mark")).withColumn("all", F.bit_or("mark").over(Window.partitionBy("s")))
    keep = "all & 2 = 2 AND all & 5 <> 0"
    out = rows.filter(keep).filter("mark & 3 <> 0").select(*FACT)
    if not with_objects:
        return out
    kept = b.select("s").distinct().join(a.select("s").union(a.select("o")).distinct(), "s", "left_semi")
    more = b.join(kept, "s", "left_semi").select(F.col("o").alias("s")).distinct().join(kept, "s", "left_anti")
    return out.unionAll(b.join(more, "s", "left_semi").select(*FACT).distinct())  # none of these has a subject of those before


def pair_difference(a: DataFrame, b: DataFrame, x: str = "c0", y: str = "c2") -> DataFrame:
    """Rows of a whose unordered pair isn't in b."""
    key = lambda d: d.withColumn("_lo", F.least(x, y)).withColumn("_hi", F.greatest(x, y))
    return key(a).join(key(b).select("_lo", "_hi").distinct(), ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")


# --- filters


def entity_filter(kb: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts whose subject is listed (``e``, with or without angle brackets)."""
    bare = lambda c: F.regexp_replace(F.trim(c), "^<|>$", "")
    return kb.withColumn("_k", bare(F.col("s"))).join(entities.select(bare(F.col("e")).alias("_k")).distinct(), "_k", "left_semi").select(*FACT)


def facts_filter(trim: DataFrame, facts: DataFrame, with_objects: bool = False) -> DataFrame:
    """Facts of ``trim`` whose subject is a subject (or object) of ``facts``."""
    keep = facts.select("s")
    keep = keep.union(facts.select("o")) if with_objects else keep
    return trim.join(keep.distinct(), "s", "left_semi").select(*FACT)


def drop_relations(kb: DataFrame, relations: list[str]) -> DataFrame:
    return kb.filter(~F.col("r").isin(*relations))


def keep_relations(kb: DataFrame, relations: list[str]) -> DataFrame:
    return kb.filter(F.col("r").isin(*relations))


def drop_small_relations(kb: DataFrame, least: int) -> DataFrame:
    return kb.join(F.broadcast(relation_sizes(kb, least).select("r")), "r", "left_semi").select(*FACT)  # a row per relation: by relation, a task would read a whole one


def top_entities(relevance: DataFrame, n: int) -> DataFrame:
    """The n entities (``e``, ``relevance``) of highest relevance, among equals by name."""
    return relevance.orderBy(F.desc("relevance"), "e").limit(n)


def relevance_filter(kb: DataFrame, entities: DataFrame, type_relation: str = "rdf:type") -> DataFrame:
    """Facts whose functional side is listed (``e``); the type relation counts as functional. Sides go to the facts, a row per relation: by relation, a task would read a whole one."""
    sides = summary(kb).select("r", ((F.col("subjects") >= F.col("objects")) | (F.col("r") == type_relation)).alias("f"))
    rows = kb.join(F.broadcast(sides), "r").withColumn("e", F.when(F.col("f"), F.col("s")).otherwise(F.col("o")))
    return rows.join(entities.select("e").distinct(), "e", "left_semi").select(*FACT)


def relevance(kb: DataFrame, lengths: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """``e``, ``relevance``: occurrences; with article lengths (``e``, ``n``) and ingoing links (``e``, ``n``) log10(length) * links * facts, what
    is missing counting 2."""
    facts = occurrences(kb)
    if lengths is None or links is None:
        return facts.select("e", F.col("n").cast("double").alias("relevance"))
    rows = facts.withColumnRenamed("n", "facts").join(lengths.select("e", F.col("n").alias("length")), "e", "left").join(links.select("e", F.col("n").alias("links")), "e", "left")
    two = lambda c: F.coalesce(F.col(c), F.lit(2))
    return rows.select("e", (F.log10(two("length")) * two("links") * two("facts")).alias("relevance"))


def ingoing_links(kb: DataFrame, relation: str = "<linksTo>") -> DataFrame:
    """Facts ``<hasIngoingLinks>`` with the count as a typed literal."""
    counts = kb.filter(F.col("r") == relation).groupBy("o").agg(F.count("*").alias("n"))
    return counts.select(F.col("o").alias("s"), F.lit("<hasIngoingLinks>").alias("r"), F.concat(F.lit('"'), F.col("n").cast("string"), F.lit('"^^xsd:integer')).alias("o"))


def materialise_inverses(kb: DataFrame) -> DataFrame:
    """Relations that are more functional the other way round are turned: ``<r>`` to ``<inv-r>``, ``r`` to ``inv-r``. Sides go to the facts as in :func:`relevance_filter`."""
    turned = summary(kb).select("r", (F.col("objects") > F.col("subjects")).alias("turn"))
    name = F.when(F.col("r").startswith("<"), F.concat(F.lit("<inv-"), F.expr("substring(r, 2)"))).otherwise(F.concat(F.lit("inv-"), "r"))
    rows = kb.join(F.broadcast(turned), "r")
    return rows.select(F.when(F.col("turn"), F.col("o")).otherwise(F.col("s")).alias("s"), F.when(F.col("turn"), name).otherwise(F.col("r")).alias("r"), F.when(F.col("turn"), F.col("s")).otherwise(F.col("o")).alias("o"))


def drop_language_codes(kb: DataFrame, relation: str = "<hasLanguageCode>") -> DataFrame:
    return kb.filter(F.col("r") != relation)


def drop_living_dead(kb: DataFrame, living: str = "<wordnet_living_people>", death: str = "<diedIn>", type_relation: str = "rdf:type") -> DataFrame:
    """Without the type "living" of those that have a place of death."""
    dead = kb.filter(F.col("r") == death).select("s").distinct()
    wrong = kb.filter((F.col("r") == type_relation) & (F.col("o") == living)).join(dead, "s", "left_semi")
    return without(kb, wrong)


def relation_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``r``, ``s``, ``change``: how a subject's set of objects changed, for subjects of the relation in both: none, addition, deletion or other."""
    one = lambda d, c: d.groupBy("r", "s").agg(F.collect_set("o").alias(c))
    rows = one(old, "a").join(one(new, "b"), ["r", "s"])
    more, less = F.size(F.array_except("b", "a")) > 0, F.size(F.array_except("a", "b")) > 0
    return rows.select("r", "s", F.when(~more & ~less, "No change").when(more & ~less, "Addition").when(~more & less, "Deletion").otherwise("Other").alias("change"))


def change_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    rows = relation_changes(old, new)
    return rows.select("s", F.when(F.col("change") == "No change", "<hasNotChanged>").otherwise("<hasChanged>").alias("r"), F.col("r").alias("o"))


def signed_relations(kb: DataFrame, types: DataFrame) -> DataFrame:
    """``r``, ``domain``, ``range``, ``n``: pairs of each relation by their types. ``types``: ``e``, ``type``."""
    rows = kb.join(types.select(F.col("e").alias("s"), F.col("type").alias("domain")), "s").join(types.select(F.col("e").alias("o"), F.col("type").alias("range")), "o")
    return rows.groupBy("r", "domain", "range").agg(F.count("*").alias("n"))


def signed_overlaps(kb: DataFrame, types: DataFrame, least: int = 3) -> DataFrame:
    """Signed relations of ``least`` pairs or more that share more than one pair: the overlap, and what share it is of each one's pairs
    whose subject the other knows. Facts are read once: pairs are reduced to their sets of relations, those of their subjects and their ends' types, and counted by these."""
    kinds = types.groupBy("e").agg(F.array_sort(F.collect_list("type")).alias("kinds"))
    pairs = kb.repartition("s").groupBy("s", "o").agg(F.array_sort(F.collect_set("r")).alias("rs"))
    pairs = pairs.withColumn("known", F.array_sort(F.array_distinct(F.flatten(F.collect_set("rs").over(Window.partitionBy("s"))))))
    typed = pairs.join(kinds.select(F.col("e").alias("s"), F.col("kinds").alias("domains")), "s").groupBy("o", "rs", "known", "domains").agg(F.count("*").alias("n"))
    typed = typed.join(kinds.select(F.col("e").alias("o"), F.col("kinds").alias("ranges")), "o").groupBy("rs", "known", "domains", "ranges").agg(F.sum("n").alias("n"))
    by_set = stored(typed, "signed-sets").select("rs", "known", "n", F.explode("domains").alias("domain"), "ranges").select("rs", "known", "n", "domain", F.explode("ranges").alias("range"))
    each = by_set.select("rs", "known", "domain", "range", "n", F.explode("rs").alias("r"))
    pairs = each.select("domain", "range", "n", F.col("r").alias("r1"), F.explode("rs").alias("r2")).filter("r1 <> r2")
    both = pairs.groupBy("domain", "range", "r1", "r2").agg(F.sum("n").alias("overlap")).filter("overlap > 1")
    keep = each.groupBy("r", "domain", "range").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).drop("n")
    both = both.join(keep.withColumnRenamed("r", "r1"), ["r1", "domain", "range"]).join(keep.withColumnRenamed("r", "r2"), ["r2", "domain", "range"])
    shared = each.select("r", "domain", "range", "n", F.explode("known").alias("other")).groupBy("r", "domain", "range", "other").agg(F.sum("n").alias("pca"))
    for a, b, out in (("r1", "r2", "pca1"), ("r2", "r1", "pca2")):
        both = both.join(shared.select(F.col("r").alias(a), "domain", "range", F.col("other").alias(b), F.col("pca").alias(out)), [a, b, "domain", "range"])
    return both.select("r1", "r2", "domain", "range", "overlap", F.try_divide("overlap", "pca1").alias("pca1"), F.try_divide("overlap", "pca2").alias("pca2"))


def join_types(kb: DataFrame, types: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Type facts (``s``, ``o``) of the subjects of kb, of the allowed types alone if given."""
    types = types.filter(F.col("o").isin(*allowed)) if allowed else types
    return types.join(kb.select("s").distinct(), "s", "left_semi").select(F.col("s"), F.lit("rdf:type").alias("r"), F.col("o"))


def join_links(kb: DataFrame, links: DataFrame, both: bool = False) -> DataFrame:
    """Links whose subject (and, with ``both``, object) is an entity of kb."""
    known = kb.select(F.col("s").alias("e")).union(kb.select("o")).distinct()
    out = links.join(known.withColumnRenamed("e", "s"), "s", "left_semi")
    out = out.join(known.withColumnRenamed("e", "o"), "o", "left_semi") if both else out
    return out.select(*FACT)


# --- columns


def substitute(rows: DataFrame, column: str, names: DataFrame, keep: bool = True) -> DataFrame:
    """A column looked up in ``names`` (``id``, ``name``); with ``keep`` what isn't in it stays, else the row goes."""
    names = names.groupBy(F.col("id").alias(column)).agg(F.min("name").alias("_name"))
    out = rows.join(names, column, "left" if keep else "inner").withColumn(column, F.coalesce("_name", column) if keep else F.col("_name"))
    return out.select(*rows.columns)


def swap(kb: DataFrame) -> DataFrame:
    return kb.select(F.col("o").alias("s"), "r", F.col("s").alias("o"))


# --- samples


def entity_sample(kb: DataFrame, n: int, seed: str = "") -> DataFrame:
    """All facts of entities drawn so that each relation has n subjects, or all if it has fewer, in the order of a hash."""
    w = Window.partitionBy("r").orderBy(F.md5(F.concat(F.lit(seed), F.col("s"))), "s")
    chosen = kb.select("r", "s").distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).select("s").distinct()
    return kb.join(chosen, "s", "left_semi").select(*FACT)


def neighbourhood(kb: DataFrame, seeds: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """Facts within so many hops of the seeds (``e``)."""
    from rulespark.operators.storage import stored

    reached = frontier = seeds.select("e").distinct()
    for _ in range(hops):
        out = kb.join(frontier.withColumnRenamed("e", "s"), "s", "left_semi").select(F.col("o").alias("e"))
        if not directed:
            out = out.union(kb.join(frontier.withColumnRenamed("e", "o"), "o", "left_semi").select(F.col("s").alias("e")))
        frontier = stored(out.distinct().join(reached, "e", "left_anti"), "hop")
        reached = reached.union(frontier)
    inner = kb.join(reached.withColumnRenamed("e", "s"), "s", "left_semi")
    return inner.join(reached.withColumnRenamed("e", "o"), "o", "left_semi").select(*FACT)
