"""Types and their hierarchy. Closures are loops that double the length of paths and end where nothing new is reached, so cycles do no harm; each round
is written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulespark.operators.storage import stored

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"


def load_names(text: str) -> dict[str, str]:
    """Names of the schema relations from ``key=value`` lines; those not given keep theirs."""
    own = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))
    return {"type": TYPE, "subClassOf": SUBCLASS, "subPropertyOf": SUBPROPERTY, "domain": DOMAIN, "range": RANGE} | {k.strip(): v.strip() for k, v in own.items()}


def transitive_closure(edges: DataFrame) -> DataFrame:
    """``a``, ``b``: b is reached from a in one step or more. ``edges``: ``a``, ``b``. Paths double: after round k all pairs of less than 2**(k + 1) steps are known, and apart
    from them those of exactly 2**k, over which the next round goes. So rounds grow with the logarithm of the depth; in a cycle some walk has any number of
    steps, so the end is where a round finds no new pair."""
    leap = stored(edges.select("a", "b").distinct(), "closure-leap")  # exactly 2**k steps
    seen = leap
    while True:
        there = leap.withColumnRenamed("b", "mid")
        over = there.join(seen.withColumnRenamed("a", "mid"), "mid").select("a", "b").distinct()
        new = stored(over.join(seen, ["a", "b"], "left_anti"), "closure-new")
        if new.isEmpty():
            return seen
        seen = stored(seen.unionAll(new), "closure")
        leap = stored(there.join(leap.withColumnRenamed("a", "mid"), "mid").select("a", "b").distinct(), "closure-leap")


def subclass_closure(schema: DataFrame) -> DataFrame:
    """``a`` is a direct or indirect subclass of ``b``; in a cycle also of itself."""
    return transitive_closure(schema.filter(F.col("r") == SUBCLASS).select(F.col("s").alias("a"), F.col("o").alias("b")))


def super_types(schema: DataFrame, kind: str, transitive: bool = True) -> DataFrame:
    rows = subclass_closure(schema) if transitive else schema.filter(F.col("r") == SUBCLASS).select(F.col("s").alias("a"), F.col("o").alias("b"))
    return rows.filter(F.col("a") == kind).select(F.col("b").alias("type"))


def sub_types(schema: DataFrame, kind: str, transitive: bool = True) -> DataFrame:
    rows = subclass_closure(schema) if transitive else schema.filter(F.col("r") == SUBCLASS).select(F.col("s").alias("a"), F.col("o").alias("b"))
    return rows.filter(F.col("b") == kind).select(F.col("a").alias("type"))


def is_super_type(schema: DataFrame, parent: str, child: str) -> bool:
    """In one step."""
    return not schema.filter((F.col("r") == SUBCLASS) & (F.col("s") == child) & (F.col("o") == parent)).isEmpty()


def leaf_types(schema: DataFrame) -> DataFrame:
    """Types without subclasses."""
    types = schema.filter(F.col("r") == TYPE).select(F.col("o").alias("type")).union(schema.filter(F.col("r") == SUBCLASS).select("s")).distinct()
    return types.join(schema.filter(F.col("r") == SUBCLASS).select(F.col("o").alias("type")), "type", "left_anti")


def materialised_types(schema: DataFrame) -> DataFrame:
    return schema.filter(F.col("r") == TYPE).select(F.col("s").alias("e"), F.col("o").alias("type")).distinct()


def most_specific_types(schema: DataFrame) -> DataFrame:
    """An entity's types of which it has no subtype."""
    own = materialised_types(schema)
    above = own.join(subclass_closure(schema).filter("a <> b").withColumnRenamed("a", "type"), "type").select("e", F.col("b").alias("type")).distinct()
    return own.join(above, ["e", "type"], "left_anti")


def all_types(schema: DataFrame) -> DataFrame:
    """Stated types and all above them."""
    own = materialised_types(schema)
    return own.union(own.join(subclass_closure(schema).withColumnRenamed("a", "type"), "type").select("e", F.col("b").alias("type"))).distinct()


def new_type_facts(schema: DataFrame) -> DataFrame:
    """Type facts that follow and aren't stated."""
    new = all_types(schema).join(materialised_types(schema), ["e", "type"], "left_anti")
    return new.select(F.col("e").alias("s"), F.lit(TYPE).alias("r"), F.col("type").alias("o"))


def second_level_types(schema: DataFrame) -> DataFrame:
    """Types with subclasses, none of which has subclasses."""
    edges = schema.filter(F.col("r") == SUBCLASS).select(F.col("s").alias("type"), F.col("o").alias("above")).distinct()
    parents = edges.select(F.col("above").alias("type")).distinct()
    deep = edges.join(parents, "type", "left_semi").select(F.col("above").alias("type")).distinct()
    return parents.join(deep, "type", "left_anti")


def keep_types(facts: DataFrame, types: DataFrame) -> DataFrame:
    """Facts without the type facts of other types than the given (``type``)."""
    wrong = facts.filter(F.col("r") == TYPE).join(types.select(F.col("type").alias("o")), "o", "left_anti")
    return facts.filter(F.col("r") != TYPE).select("s", "r", "o").unionAll(facts.filter(F.col("r") == TYPE).join(wrong.select("s", "r", "o"), ["s", "r", "o"], "left_anti").select("s", "r", "o"))


def lift_leaf_types(facts: DataFrame, schema: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Type facts of leaf types give way to those of all types above them (of the allowed ones alone, if given); other facts stay."""
    typed = facts.filter(F.col("r") == TYPE).select("s", F.col("o").alias("type"))
    inner = schema.filter(F.col("r") == SUBCLASS).select(F.col("o").alias("type")).distinct()
    above = subclass_closure(schema).filter("a <> b")
    above = above.filter(F.col("b").isin(*allowed)) if allowed else above
    lifted = typed.join(inner, "type", "left_anti").join(above.select(F.col("a").alias("type"), F.col("b").alias("o")), "type").select("s", "o")
    types = typed.join(inner, "type", "left_semi").select("s", F.col("type").alias("o")).union(lifted).distinct()
    return facts.filter(F.col("r") != TYPE).select("s", "r", "o").union(types.select("s", F.lit(TYPE).alias("r"), "o"))


def join_all_types(kb: DataFrame, schema: DataFrame) -> DataFrame:
    """The facts and all types, stated and above, of their subjects and objects."""
    entities = kb.select(F.col("s").alias("e")).union(kb.select("o")).distinct()
    types = all_types(schema).join(entities, "e", "left_semi")
    return kb.select("s", "r", "o").union(types.select("e", F.lit(TYPE), "type")).distinct()


def declared(kb: DataFrame, mark: str) -> DataFrame:
    """Relations with a fact (relation, mark, TRUE): ``<isFunction>`` for functions, ``<isMandatory>`` for those that all of the domain have."""
    return kb.filter((F.col("r") == mark) & (F.col("o") == "TRUE")).select(F.col("s").alias("r")).distinct()


def entities_of_type(schema: DataFrame, kind: str) -> DataFrame:
    return materialised_types(schema).filter(F.col("type") == kind).select("e")


def signatures(schema: DataFrame) -> DataFrame:
    """``r``, ``domain``, ``range``: stated, else of a property one step above; of several the least."""

    def one(kind: str, column: str) -> DataFrame:
        stated = schema.filter(F.col("r") == kind).groupBy("s").agg(F.min("o").alias("stated"))
        above = schema.filter(F.col("r") == SUBPROPERTY).select(F.col("s").alias("sub"), F.col("o").alias("s")).join(stated, "s").groupBy("sub").agg(F.min("stated").alias("above")).withColumnRenamed("sub", "s")
        return stated.join(above, "s", "full").select(F.col("s").alias("r"), F.coalesce("stated", "above").alias(column))

    return one(DOMAIN, "domain").join(one(RANGE, "range"), "r", "full").select("r", "domain", "range")


def side_set(kb: DataFrame, schema: DataFrame, relation: str, side: str = "s", both: bool = False) -> DataFrame:
    """Entities typed as the relation's domain (or range) or used in it; with ``both`` those that are typed and used."""
    column = "domain" if side == "s" else "range"
    kinds = signatures(schema).filter(F.col("r") == relation).select(F.col(column).alias("type"))
    typed = materialised_types(schema).join(kinds, "type", "left_semi").select("e").distinct()
    used = kb.filter(F.col("r") == relation).select(F.col(side).alias("e")).distinct()
    return typed.join(used, "e", "left_semi") if both else typed.union(used).distinct()
