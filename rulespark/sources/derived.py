"""A knowledge base made of the star-schema test tables."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _id(prefix: str, column) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string")) if isinstance(column, str) else F.concat(F.lit(prefix), column.cast("string"))


#: Integral types, whose text and value tell the same keys apart.
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _distinct(parts: list[tuple[str, DataFrame, str, str, str, str]]) -> DataFrame:
    """``s``, ``r``, ``o`` without repetition, of parts ``(relation, rows, prefix and column of the subject, prefix and column of the object)``. Rows are compared and
    shuffled as keys, and named after that: keys are a fraction of the names. Names are put before all the keys of a relation's side alike, so equal
    names are equal keys; a relation of several parts is compared by names."""
    groups: dict[tuple, list] = defaultdict(list)
    times = Counter(part[0] for part in parts)
    for relation, df, *ends in parts:
        kinds = tuple("bigint" if isinstance(df.schema[c].dataType, _WHOLE) else "string" for c in ends[1::2]) if times[relation] == 1 else None
        groups[kinds].append((relation, df, *ends))
    out = []
    for kinds, members in groups.items():
        name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
        if kinds is None:
            out.append(reduce(DataFrame.unionAll, [df.select(name(p, a).alias("s"), F.lit(r).alias("r"), name(q, b).alias("o")) for r, df, p, a, q, b in members]).distinct())
            continue
        rows = reduce(DataFrame.unionAll, [df.select(F.lit(i).alias("k"), F.col(a).cast(kinds[0]).alias("a"), F.col(b).cast(kinds[1]).alias("b")) for i, (_, df, _, a, _, b) in enumerate(members)]).distinct()
        chosen = lambda at: reduce(lambda w, i: w.when(F.col("k") == i, members[i][at]), range(1, len(members)), F.when(F.col("k") == 0, members[0][at]))
        out.append(rows.select(F.concat(chosen(2), F.col("a").cast("string")).alias("s"), chosen(0).alias("r"), F.concat(chosen(4), F.col("b").cast("string")).alias("o")))
    return reduce(DataFrame.unionAll, out)


def derived_kb(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """``s``, ``r``, ``o``. ``before``: only what orders dated before it say."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    if before:
        orders = orders.filter(F.col("o_orderdate") < F.lit(before).cast("timestamp"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    if before:
        lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    sold = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    nation, customer = t("nation"), t("customer")
    near = nation.select(F.col("n_nationkey").alias("m"), F.col("n_regionkey").alias("g"))
    return _distinct([
        ("placedBy", orders, "o", "o_orderkey", "c", "o_custkey"),
        ("hasStatus", orders, "o", "o_orderkey", "st_", "o_orderstatus"),
        ("hasPriority", orders, "o", "o_orderkey", "pr_", "o_orderpriority"),
        ("inNation", customer, "c", "c_custkey", "n", "c_nationkey"),
        ("inNation", t("supplier"), "s", "s_suppkey", "n", "s_nationkey"),
        ("inSegment", customer, "c", "c_custkey", "sg_", "c_mktsegment"),
        ("inRegion", nation, "n", "n_nationkey", "g", "n_regionkey"),
        ("hasBrand", t("part"), "p", "p_partkey", "b_", "p_brand"),
        ("hasPart", lines, "o", "l_orderkey", "p", "l_partkey"),
        ("hasSupplier", lines, "o", "l_orderkey", "s", "l_suppkey"),
        ("suppliedBy", lines, "p", "l_partkey", "s", "l_suppkey"),
        ("bought", sold, "c", "o_custkey", "p", "l_partkey"),
        ("boughtFrom", sold, "c", "o_custkey", "s", "l_suppkey"),
        ("returned", sold.filter("l_returnflag = 'R'"), "c", "o_custkey", "p", "l_partkey"),
        ("soldTo", sold.filter("o_orderstatus = 'F'"), "s", "l_suppkey", "c", "o_custkey"),
        ("neighbour", nation.join(near, (F.col("n_regionkey") == F.col("g")) & (F.col("n_nationkey") != F.col("m"))), "n", "n_nationkey", "n", "m"),
        ("did", t("events"), "c", "user_id", "ev_", "event_type"),
    ])


def derived_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, a class hierarchy with a cycle, domains, ranges and a sub-property."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    typed = [("customer", "c_custkey", "c", "Customer"), ("supplier", "s_suppkey", "s", "Supplier"), ("part", "p_partkey", "p", "Part"), ("orders", "o_orderkey", "o", "Order"), ("nation", "n_nationkey", "n", "Nation"), ("region", "r_regionkey", "g", "Region")]
    types = [t(name).select(_id(prefix, key).alias("s"), F.lit("rdf:type").alias("r"), F.lit(kind).alias("o")) for name, key, prefix, kind in typed]
    fixed = [
        ("Customer", "rdfs:subClassOf", "Party"),
        ("Supplier", "rdfs:subClassOf", "Party"),
        ("Party", "rdfs:subClassOf", "Thing"),
        ("Thing", "rdfs:subClassOf", "Party"),
        ("placedBy", "rdfs:domain", "Order"),
        ("placedBy", "rdfs:range", "Customer"),
        ("boughtFrom", "rdfs:subPropertyOf", "dealsWith"),
        ("dealsWith", "rdfs:domain", "Party"),
    ]
    return reduce(DataFrame.union, [*types, spark.createDataFrame(fixed, "s string, r string, o string")])


def derived_probabilistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with a probability from 0.5 to 0.99 made of their md5."""
    digest = F.md5(F.concat("s", "r", "o"))
    return derived_kb(spark, sf_dir).withColumn("p", F.lit(0.5) + (F.ascii(digest) + F.ascii(F.substring(digest, 2, 1))) % 50 / F.lit(100.0))


def _other(kept_as: str) -> tuple[F.Column, F.Column]:
    """Whether the second knowledge base has a fact, and its name for the relation."""
    return ~F.substring(F.md5(F.concat("s", "r", "o")), 1, 1).isin("0", "1", "2"), F.concat(F.lit("<db:"), "r", F.lit(">")).alias(kept_as)


def derived_other(spark: SparkSession, sf_dir: str, kb: DataFrame | None = None) -> DataFrame:
    """A second knowledge base: relations renamed, about a fifth of the facts left out by their md5. ``kb``: the facts, if they are there already."""
    kb = derived_kb(spark, sf_dir) if kb is None else kb
    kept, name = _other("r")
    return kb.filter(kept).select("s", name, "o")


def derived_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of both knowledge bases, derived once."""
    kept, name = _other("r")
    return derived_kb(spark, sf_dir).select("s", F.explode(F.when(kept, F.array("r", name)).otherwise(F.array("r"))).alias("r"), "o")
