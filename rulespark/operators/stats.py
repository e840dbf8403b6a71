"""Statistics of relations, fan-outs, overlaps, types and signatures: each one aggregation over the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rulespark.functions.text import ratio
from rulespark.operators.storage import stored


def kb_size(kb: DataFrame) -> DataFrame:
    """One row: facts, distinct subjects, relations, objects, entities (subjects or objects)."""
    entities = kb.select(F.col("s").alias("e")).union(kb.select("o")).distinct().agg(F.count("*").alias("entities"))
    return kb.agg(F.count("*").alias("facts"), F.count_distinct("s").alias("subjects"), F.count_distinct("r").alias("relations"), F.count_distinct("o").alias("objects")).join(entities, F.lit(True))


def relation_sizes(kb: DataFrame, least: int = 0) -> DataFrame:
    return kb.groupBy("r").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def entities(kb: DataFrame) -> DataFrame:
    return kb.select(F.col("s").alias("e")).union(kb.select("o")).distinct()


def occurrences(kb: DataFrame, wanted: DataFrame | None = None, omitted: list[str] = ()) -> DataFrame:
    """How often each entity is a subject or an object, ``wanted`` (``e``) alone if given, facts of omitted relations left out."""
    kb = kb.filter(~F.col("r").isin(*omitted)) if omitted else kb
    rows = kb.select(F.col("s").alias("e")).unionAll(kb.select("o"))
    rows = rows.join(wanted, "e", "left_semi") if wanted is not None else rows
    return rows.groupBy("e").agg(F.count("*").alias("n"))


def degrees(kb: DataFrame, side: str = "s") -> DataFrame:
    """``r``, ``e``, ``deg``: facts of the relation that the entity has on that side."""
    return kb.groupBy("r", F.col(side).alias("e")).agg(F.count("*").alias("deg"))


def summary(kb: DataFrame) -> DataFrame:
    """For each relation: size, subjects, objects, functionality, inverse functionality, their fan-outs' population variances, largest
    fan-outs. Degrees are aggregated first, so no distinct count needs the facts twice."""

    def one(side: str, names: tuple[str, str, str]) -> DataFrame:
        return degrees(kb, side).groupBy("r").agg(F.count("*").alias(names[0]), F.var_pop("deg").alias(names[1]), F.max("deg").alias(names[2]), F.sum("deg").alias(f"{side}_size"))

    rows = one("s", ("subjects", "variance", "max_out")).join(one("o", ("objects", "inverse_variance", "max_in")), "r")
    return rows.select("r", F.col("s_size").alias("size"), "subjects", "objects", ratio(F.col("subjects"), F.col("s_size")).alias("functionality"), ratio(F.col("objects"), F.col("s_size")).alias("inverse_functionality"), "variance", "inverse_variance", "max_out", "max_in")


def functionality(kb: DataFrame) -> DataFrame:
    return degrees(kb, "s").groupBy("r").agg(F.count("*").alias("subjects"), F.sum("deg").alias("size")).select("r", ratio(F.col("subjects"), F.col("size")).alias("functionality"))


def inverse_functionality(kb: DataFrame) -> DataFrame:
    return degrees(kb, "o").groupBy("r").agg(F.count("*").alias("objects"), F.sum("deg").alias("size")).select("r", ratio(F.col("objects"), F.col("size")).alias("inverse_functionality"))


def functional_sides(kb: DataFrame) -> DataFrame:
    """``functional``: functionality at least as high as the inverse."""
    return summary(kb).select("r", (F.col("subjects") >= F.col("objects")).alias("functional"))


def overlaps(kb: DataFrame, left: str = "s", right: str = "s") -> DataFrame:
    """``r1``, ``r2``, ``n``: entities that are on the left side of r1 and on the right side of r2; pairs of one relation only for two sides.
    Entities are first reduced to the set of relations they take part in, so the work is by distinct sets, not by entities."""
    a = kb.select("r", F.col(left).alias("e")).distinct().groupBy("e").agg(F.array_sort(F.collect_set("r")).alias("ra"))
    if left == right:
        sets = a.groupBy("ra").agg(F.count("*").alias("n")).select("ra", F.col("ra").alias("rb"), "n")
    else:
        b = kb.select("r", F.col(right).alias("e")).distinct().groupBy("e").agg(F.array_sort(F.collect_set("r")).alias("rb"))
        sets = a.join(b, "e").groupBy("ra", "rb").agg(F.count("*").alias("n"))
    rows = sets.select(F.explode("ra").alias("r1"), "rb", "n").select("r1", F.explode("rb").alias("r2"), "n").groupBy("r1", "r2").agg(F.sum("n").alias("n"))
    return rows.filter("r1 <> r2")


def own_labels(kb: DataFrame) -> DataFrame:
    """``e``, ``own``: for each entity its labels (relations with ``+`` on the subject's side, with ``-`` on the object's) and how many facts it has of each. Facts are read once."""
    ends = kb.select(F.explode(F.array(F.struct(F.col("s").alias("e"), F.concat("r", F.lit("+")).alias("l")), F.struct(F.col("o").alias("e"), F.concat("r", F.lit("-")).alias("l")))).alias("end"))
    return ends.groupBy("end.e", "end.l").agg(F.count("*").alias("n")).groupBy("e").agg(F.array_sort(F.collect_list(F.struct("l", "n"))).alias("own"))


def label_sets(kb: DataFrame) -> DataFrame:
    """``known``, ``set``, ``l``, ``facts``, ``entities``: entities by their sorted set of labels, and for each label of the set their facts; null (not ``known``) apart. What is stored are
    counts of sets; sizes and overlaps of any sides come from them."""
    rows = own_labels(kb).select(F.col("e").isNotNull().alias("known"), F.col("own.l").alias("set"), F.explode("own").alias("one"))
    return stored(rows.groupBy("known", "set", F.col("one.l").alias("l")).agg(F.sum("one.n").alias("facts"), F.count("*").alias("entities")), "label-sets")


def overlap_report(kb: DataFrame) -> DataFrame:
    """All overlaps of two relations and their sides' sizes, from one count of entities' sets of labels."""
    sets = label_sets(kb).filter("known")
    bare = lambda c: F.expr(f"left({c}, length({c}) - 1)")
    side = lambda c: F.when(F.col(c).endswith("+"), "s").otherwise("o")
    pairs = sets.select("l", F.explode("set").alias("l2"), "entities").select(bare("l").alias("r1"), bare("l2").alias("r2"), F.concat(side("l"), side("l2")).alias("sides"), "entities")
    sums = [F.coalesce(F.sum(F.when(F.col("sides") == k, F.col("entities"))), F.lit(0)).alias(k) for k in ("ss", "so", "os", "oo")]
    rows = pairs.filter("r1 <> r2").groupBy("r1", "r2").agg(*sums)
    sizes = sets.groupBy(bare("l").alias("r")).agg(*[F.coalesce(F.sum(F.when(side("l") == k, F.col("entities"))), F.lit(0)).alias(name) for k, name in (("s", "subjects"), ("o", "objects"))])
    for k in ("1", "2"):
        rows = rows.join(sizes.select(F.col("r").alias(f"r{k}"), F.col("subjects").alias(f"subjects{k}"), F.col("objects").alias(f"objects{k}")), f"r{k}")
    return rows.select("r1", "r2", "ss", "so", "os", "oo", "subjects1", "objects1", "subjects2", "objects2")


def fanout_histogram(kb: DataFrame, side: str = "s") -> DataFrame:
    return degrees(kb, side).groupBy("r", "deg").agg(F.count("*").alias("n"))


def cumulative_histogram(kb: DataFrame, side: str = "s") -> DataFrame:
    """``r``, ``above``, ``n``: entities with a fan-out over ``above`` (0, 1, ...). Sums over the histogram, not over entities."""
    w = Window.partitionBy("r").orderBy(F.desc("deg"))
    steps = fanout_histogram(kb, side).select("r", "deg", F.sum("n").over(w).alias("n"), F.lead("deg", 1, 0).over(w).alias("low"))
    return steps.select("r", F.explode(F.sequence(F.col("low"), F.col("deg") - 1)).alias("above"), "n")


def fanout_distribution(kb: DataFrame, side: str = "s") -> DataFrame:
    """The histogram with probability and tail (entities with a higher fan-out)."""
    hist = fanout_histogram(kb, side)
    total = hist.groupBy("r").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("r").orderBy("deg")
    return hist.join(total, "r").select("r", "deg", "n", ratio(F.col("n"), F.col("total")).alias("p"), (1 - ratio(F.sum("n").over(w), F.col("total"))).alias("tail"))


def maximal_cardinality(kb: DataFrame, side: str = "s", limit: int | None = None) -> DataFrame:
    """Largest fan-out of each relation; with a limit the largest below it, else the limit."""
    d = degrees(kb, side)
    if limit is None:
        return d.groupBy("r").agg(F.max("deg").alias("n"))
    return d.groupBy("r").agg(F.coalesce(F.max(F.when(F.col("deg") < limit, F.col("deg"))), F.lit(limit).cast("long")).alias("n"))


def right_cumulative_cardinality(kb: DataFrame, least: int, limit: int, side: str = "s") -> DataFrame:
    """Smallest fan-out over the limit whose cumulative count is lower than at the limit and at least ``least``; -1 if there is none."""
    cum = cumulative_histogram(kb, side)
    at = cum.filter(F.col("above") == limit).select("r", F.col("n").alias("bound"))
    found = cum.join(at, "r").filter((F.col("above") > limit) & (F.col("n") < F.col("bound")) & (F.col("n") >= least)).groupBy("r").agg(F.min("above").alias("k"))
    return kb.select("r").distinct().join(found, "r", "left").select("r", F.coalesce("k", F.lit(-1)).cast("long").alias("n"))


def with_cardinality(kb: DataFrame, relation: str, n: int) -> DataFrame:
    """Entities of the relation's functional side with exactly n values."""
    own = kb.filter(F.col("r") == relation)
    sides = own.agg(F.count_distinct("s").alias("a"), F.count_distinct("o").alias("b")).head()
    return degrees(own, "s" if sides["a"] >= sides["b"] else "o").filter(F.col("deg") == n).select("e")


# --- types


def type_sizes(kb: DataFrame, type_relation: str = "rdf:type") -> DataFrame:
    return kb.filter(F.col("r") == type_relation).groupBy(F.col("o").alias("type")).agg(F.count("*").alias("n"))


def domain_histogram(kb: DataFrame, relation: str, domain: DataFrame) -> DataFrame:
    """Fan-outs over a typed domain (``e``), entities without facts included."""
    counts = degrees(kb.filter(F.col("r") == relation), "s").select("e", "deg")
    return domain.select("e").distinct().join(counts, "e", "left").groupBy(F.coalesce("deg", F.lit(0)).alias("deg")).agg(F.count("*").alias("n"))


def typed_distribution(kb: DataFrame, schema: DataFrame) -> DataFrame:
    """``r``, ``deg``, ``n``, ``p``: fan-outs over all entities of each relation's domain type, those without facts included."""
    from rulespark.operators.schema import materialised_types, signatures

    domains = signatures(schema).filter("domain is not null").select("r", F.col("domain").alias("type"))
    universe = domains.join(materialised_types(schema), "type").select("r", "e")
    rows = universe.join(degrees(kb, "s"), ["r", "e"], "left").groupBy("r", F.coalesce("deg", F.lit(0)).alias("deg")).agg(F.count("*").alias("n"))
    return rows.join(universe.groupBy("r").agg(F.count("*").alias("total")), "r").select("r", "deg", "n", ratio(F.col("n"), F.col("total")).alias("p"))


def signature_statistics(kb: DataFrame, types: DataFrame) -> DataFrame:
    """For each relation and type: entities of that type among subjects and objects, the type's size and the relation's. ``types``: ``s``, ``o``."""
    types = types.select(F.col("s").alias("e"), F.col("o").alias("type")).distinct()

    def one(side: str, column: str) -> DataFrame:
        return kb.select("r", F.col(side).alias("e")).distinct().join(types, "e").groupBy("r", "type").agg(F.count("*").alias(column))

    rows = one("s", "on_domain").join(one("o", "on_range"), ["r", "type"], "full").fillna(0, ["on_domain", "on_range"])
    return rows.join(types.groupBy("type").agg(F.count("*").alias("type_size")), "type").join(relation_sizes(kb).withColumnRenamed("n", "relation_size"), "r").select("r", "type", "on_domain", "on_range", "type_size", "relation_size")


def common_relations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both knowledge bases' summaries of the relations that they share."""
    mark = lambda d, k: d.select("r", *[F.col(c).alias(f"{c}_{k}") for c in ("size", "functionality", "inverse_functionality")])
    return mark(summary(a), "a").join(mark(summary(b), "b"), "r")


def contradictions(kb: DataFrame, relations: list[str]) -> DataFrame:
    """Subjects with several objects of a relation that should have one."""
    return degrees(kb.filter(F.col("r").isin(*relations)), "s").filter("deg > 1")


def hub_pairs(kb: DataFrame, on: str = "o") -> DataFrame:
    """For each relation the rows that r(x,z), r(y,z) makes before duplicates go: the sum of squared degrees, known before any such join runs."""
    return degrees(kb, on).groupBy("r").agg(F.sum(F.col("deg").cast("double") * F.col("deg")).alias("pairs"))


def star_pca_estimate(kb: DataFrame, relation: str, head: str, head_side: str = "s", on: str = "o") -> DataFrame:
    """An estimate of the pairs (x, y) of r(x,z), r(y,z) whose x has the head's relation: r's facts of such x less the repeats that x's fan-out makes."""
    side = "s" if on == "o" else "o"
    own = kb.filter(F.col("r") == relation)
    heads = kb.filter(F.col("r") == head).select(F.col(head_side).alias(side)).distinct()
    known = own.join(heads, side, "left_semi").agg(F.count("*").alias("facts"), F.count_distinct(side).alias("entities"))
    fan = own.agg(F.count("*").alias("n"), F.count_distinct(side).alias("k"))
    return known.join(fan, F.lit(True)).select((F.col("facts") - F.ceil(F.col("entities") * (ratio(F.col("n"), F.col("k")) - 1))).alias("n"))


def link_statistics(kb: DataFrame, link: str = "<linksTo>") -> DataFrame:
    """One row: links, and those between pairs that another relation joins too."""
    other = kb.filter(F.col("r") != link).select("s", "o").distinct().withColumn("known", F.lit(1))
    return kb.filter(F.col("r") == link).join(other, ["s", "o"], "left").agg(F.count("*").alias("links"), F.count("known").alias("semantified"))


def star_pairs_estimate(kb: DataFrame, relation: str, on: str = "o") -> DataFrame:
    """An estimate of the distinct pairs of r(x,z), r(y,z): the squared degrees less an even share of repeats."""
    own = kb.filter(F.col("r") == relation)
    sides = own.agg(F.count("*").alias("n"), F.count_distinct("s" if on == "o" else "o").alias("k"))
    total = degrees(own, on).agg(F.sum(F.col("deg").cast("double") * F.col("deg")).alias("pairs"))
    return total.join(sides, F.lit(True)).select((F.col("pairs") - F.ceil(F.col("pairs") * (1 - ratio(F.col("k"), F.col("n"))))).alias("n"))
