"""Further registered queries: readers and writers, schema, rule algebra, sets and text, mining languages, inference. Same registry and
knowledge base as :mod:`rulespark.plans.queries`."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespark.functions import text
from rulespark.operators import biases, metrics, miner, predict, schema, setops, stats
from rulespark.operators.storage import shared_dir, stored
from rulespark.plans import bgp, terms
from rulespark.plans.queries import _CLOSURE, _KB, _META, _OLD, _OTHER, _RULES, _TYPES, ORACLES, SPLIT, TRAINED, _atoms, _simple, _trained, register
from rulespark.plans.terms import Atom, Rule, parse_rule
from rulespark.sources import readers
from rulespark.sources.derived import derived_kb, derived_other, derived_probabilistic, derived_schema
from rulespark.streaming.append import append_facts, fact_stream

_DONE = " done AS (SELECT 1) "


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, name: str, *lines: DataFrame) -> str:
    """A folder of text files, one for each frame of lines (``value``), compressed; a task's lines are a file."""
    path = _folder(spark, name)
    for i, part in enumerate(lines):
        part.write.text(f"{path}/{i}", compression="gzip")
    return path


def _rows(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(list(rows), columns)


# --- readers and writers, each over the whole knowledge base written as text


@register("tsv_facts", _KB + _DONE + """SELECT s, r, CASE WHEN r = 'hasBrand' THEN '"' || o || '"' ELSE o END AS o FROM kb""")
def _tsv(spark: SparkSession, d: str) -> DataFrame:
    """Three and four fields, typed literals, points at line ends, spaces, and lines of other widths, in files of nested folders."""
    kb = derived_kb(spark, d)
    o = F.when(F.col("r") == "hasBrand", F.concat(F.lit('"'), "o", F.lit('"^^<xsd:string>'))).otherwise(F.col("o"))
    plain = kb.select(F.concat_ws("\t", "s", F.concat(F.lit(" "), "r"), o).alias("value")).unionAll(_rows(spark, [("one field",), ("two\tfields",), ("a\tb\tc\td\te",), ("",)], "value string"))
    with_ids = kb.filter("r in ('inNation', 'bought')").select(F.concat(F.lit("id1\t"), F.concat_ws("\t", "s", "r", "o"), F.lit(".")).alias("value"))
    return readers.load_kb(spark, _written(spark, "tsv", plain, with_ids))


@register("tsv_dump", _KB + _DONE + "SELECT s, r, o FROM kb")
def _dump(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "dump")
    readers.write_facts(derived_kb(spark, d), path)
    return readers.read_facts(spark, [path])


@register("index_load", _KB + _DONE + "SELECT s, r, o FROM kb")
def _index(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "index")
    readers.write_partitioned(derived_kb(spark, d), path)
    return readers.load_kb(spark, path, "index")


@register("probabilistic_facts", _KB + """ p AS (SELECT s, r, o, CASE WHEN r = 'did' THEN 1.0 WHEN r = 'inNation' THEN 0.75 ELSE 0.5 END::DOUBLE AS p FROM kb) SELECT s, r, o, p FROM p""")
def _probabilistic_facts(spark: SparkSession, d: str) -> DataFrame:
    """What is no number counts as 1, of several the highest counts."""
    kb = derived_kb(spark, d)
    p = F.when(F.col("r") == "did", "certain").when(F.col("r") == "inNation", "0.25").otherwise("0.5")
    line = lambda rows, p: rows.select(F.concat_ws("\t", F.lit("id"), "s", "r", "o", p).alias("value"))
    return readers.load_kb(spark, _written(spark, "probabilistic", line(kb, p), line(kb.filter("r = 'inNation'"), F.lit("0.75"))), "probabilistic")


@register("spaced_facts", _KB + _DONE + """SELECT '<' || s || '>' AS s, '<' || r || '>' AS r, CASE WHEN r = 'hasBrand' THEN '"' || o || '"' ELSE '<' || o || '>' END AS o FROM kb""")
def _spaced(spark: SparkSession, d: str) -> DataFrame:
    entity = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    o = F.when(F.col("r") == "hasBrand", F.concat(F.lit('"'), "o", F.lit('"^^xsd:string'))).otherwise(entity("o"))
    lines = derived_kb(spark, d).select(F.concat(entity("s"), F.lit(" "), entity("r"), F.lit(" "), o, F.lit(" .")).alias("value"))
    return readers.load_kb(spark, _written(spark, "spaced", lines), "spaced")


@register("mapped_entities", _KB + _DONE + "SELECT DISTINCT CASE WHEN s LIKE 'c%' THEN 'client' || substr(s, 2) ELSE s END AS s, r, CASE WHEN o LIKE 'c%' THEN 'client' || substr(o, 2) ELSE o END AS o FROM kb")
def _mapped(spark: SparkSession, d: str) -> DataFrame:
    kb = derived_kb(spark, d)
    clients = stats.entities(kb).filter("e like 'c%'").select(F.col("e").alias("old"), F.expr("concat('client', substring(e, 2))").alias("new"))
    return readers.map_entities(kb, clients)


def _ntriples(spark: SparkSession, d: str) -> DataFrame:
    """The triples of a file, read once; what is made of them is made distinct."""
    uri = lambda c: F.concat(F.lit("<http://x.org/"), c, F.lit(">"))
    kb = stored(derived_kb(spark, d), "facts")
    facts = kb.select(F.concat_ws(" ", uri("s"), F.concat(F.lit("<http://x.org/"), "r", F.lit("c>")), uri("o"), F.lit(".")).alias("value"))
    names = stats.entities(kb).filter("e like 'c%' or e like 'n%'").select(F.concat(uri("e"), F.lit(' <http://www.w3.org/2000/01/rdf-schema#label> "My '), "e", F.lit('"@en .')).alias("value"))
    other = _rows(spark, [('<http://x.org/c1> <http://www.w3.org/2000/01/rdf-schema#label> "Kunde"@de .',), ("no triple",)], "value string")
    return stored(readers.parse_ntriples(spark, _written(spark, "ntriples", facts, names, other)), "triples")


@register("ntriples_labels", _KB + _DONE + "SELECT '<http://x.org/' || e || '>' AS id, '<My_' || e || '_' || e || '>' AS name FROM (SELECT s AS e FROM kb UNION SELECT o FROM kb) WHERE e LIKE 'c%' OR e LIKE 'n%'")
def _labels(spark: SparkSession, d: str) -> DataFrame:
    return readers.label_names(_ntriples(spark, d))


@register("ntriples_renamed", _KB + _DONE + "SELECT '<My_' || s || '_' || s || '>' AS s, '<is-' || r || '>' AS r, '<My_' || o || '_' || o || '>' AS o FROM kb WHERE s[1] IN ('c', 'n') AND o[1] IN ('c', 'n')")
def _renamed(spark: SparkSession, d: str) -> DataFrame:
    triples = _ntriples(spark, d)
    r = F.regexp_extract("r", "^<http://x.org/(.*)c>$", 1)
    relations = triples.filter(r != "").select(r.alias("r")).distinct().select(F.concat(F.lit("<http://x.org/"), "r", F.lit(">")).alias("id"), F.concat(F.lit("<is-"), "r", F.lit(">")).alias("name"))
    return readers.rename_entities(triples, stored(readers.label_names(triples), "names"), relations)


@register("ntriples_literals", _KB + _DONE + """SELECT '<My_' || s || '_' || s || '>' AS s, '<http://x.org/' || r || 'c>' AS r, '"<http://x.org/' || o || '>"' AS o FROM kb WHERE s[1] IN ('c', 'n') AND o[1] NOT IN ('c', 'n')""")
def _renamed_literals(spark: SparkSession, d: str) -> DataFrame:
    triples = _ntriples(spark, d)
    rows = readers.rename_entities(triples.filter("r <> '<http://www.w3.org/2000/01/rdf-schema#label>'"), stored(readers.label_names(triples), "names"), literals=True)
    return rows.filter(F.col("o").startswith('"'))


@register("html_table", _KB + """ sizes AS (SELECT r, count(*) AS n FROM kb GROUP BY r)
SELECT '<table>' || chr(10) || '<tr><th>r</th><th>n</th></tr>' || chr(10) || string_agg('<tr><td align="right">' || r || '</td><td align="right">' || n || '</td></tr>' || chr(10), '' ORDER BY r) || '</table>' || chr(10) AS html FROM sizes""")
def _html(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(readers.to_html(stats.relation_sizes(derived_kb(spark, d)).orderBy("r"), ["r", "n"], 100, "right"),)], "html string")


@register("stream_append", _KB + _DONE + "SELECT s, r, o FROM kb")
def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The facts as two folders of files, some in both, through the stream."""
    kb = derived_kb(spark, d)
    path, root = _folder(spark, "incoming"), _folder(spark, "appended")
    for part in (kb.filter("r < 'i'"), kb.filter("r >= 'hasQ'")):
        part.select(F.concat_ws("\t", "s", "r", "o").alias("value")).write.mode("append").text(path, compression="gzip")
        append_facts(fact_stream(spark, path), root, f"{root}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("s string, r string, o string, batch long").parquet(root).select("s", "r", "o")


# --- single patterns and queries


@register("fact_deletion", _KB + _DONE + "SELECT s, r, o FROM kb WHERE r <> 'did'")
def _deletion(spark: SparkSession, d: str) -> DataFrame:
    kb = derived_kb(spark, d)
    return setops.without(kb, kb.filter("r = 'did'"))


@register("contained_facts", _KB + """ q(n, found) AS (VALUES (1, (SELECT count(*) > 0 FROM kb WHERE s = 'c1' AND r = 'inNation' AND o = 'n1')), (2, (SELECT count(*) > 0 FROM kb WHERE s = 'n0' AND r = 'inRegion' AND o = 'g0')),
  (3, (SELECT count(*) > 0 FROM kb WHERE s = 'c1' AND r = 'bought')), (4, (SELECT count(*) = 0 FROM kb WHERE s = 'c2' AND r = 'bought')), (5, true), (6, true), (7, false), (8, (SELECT count(*) > 2 FROM kb WHERE s = 'c1' AND r = 'bought'))) SELECT n, found FROM q""")
def _contained(spark: SparkSession, d: str) -> DataFrame:
    kb = derived_kb(spark, d)
    asked = _atoms("c1 inNation n1;n0 inRegion g0;bought exists c1;bought ~exists c2;bought ~exists nobody;a differentFrom b;a equals b;c1 hasNumberOfValuesGreaterThan2 bought")
    return _rows(spark, [(i, bgp.contains(kb, a)) for i, a in enumerate(asked, 1)], "n int, found boolean")


@register("pattern_counts", _KB + """ q(n, k) AS (VALUES (1, (SELECT count(*) FROM kb)), (2, (SELECT count(*) FROM kb WHERE r = 'bought')), (3, (SELECT count(*) FROM kb WHERE s = 'c1' AND r = 'bought')), (4, (SELECT count(*) FROM kb WHERE s = 'n0' AND r = 'inRegion' AND o = 'g0')),
  (5, (SELECT count(*) FROM kb WHERE s = 'c1')), (6, (SELECT count(DISTINCT s) FROM kb WHERE r = 'returned'))) SELECT n, k FROM q""")
def _pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    kb = derived_kb(spark, d)
    asked = _atoms("?x ?r ?y;?x bought ?y;c1 bought ?y;n0 inRegion g0;c1 ?r ?y;returned exists ?x")
    return _rows(spark, [(i, bgp.count(kb, a)) for i, a in enumerate(asked, 1)], "n int, k long")


@register("query_existence", _KB + """ q(n, found) AS (VALUES (1, (SELECT count(*) > 0 FROM kb a JOIN kb b ON a.o = b.s WHERE a.r = 'returned' AND b.r = 'suppliedBy' AND a.s = 'c1')), (2, (SELECT count(*) > 0 FROM kb a JOIN kb b ON a.o = b.s WHERE a.r = 'inRegion' AND b.r = 'inRegion')), (3, false)) SELECT n, found FROM q""")
def _query_existence(spark: SparkSession, d: str) -> DataFrame:
    kb = derived_kb(spark, d)
    return _rows(spark, [(1, bgp.exists(kb, _atoms("c1 returned ?y;?y suppliedBy ?z"))), (2, bgp.exists(kb, _atoms("?x inRegion ?y;?y inRegion ?z"))), (3, bgp.exists(kb, []))], "n int, found boolean")


@register("distinct_counts", _KB + """ j AS (SELECT a.s AS x, a.o AS y, b.o AS z FROM kb a JOIN kb b ON a.o = b.s WHERE a.r = 'returned' AND b.r = 'suppliedBy') SELECT count(DISTINCT x) AS x, count(DISTINCT (x, y)) AS xy, count(DISTINCT (x, y, z)) AS xyz FROM j""")
def _distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    kb, q = derived_kb(spark, d), _atoms("?x returned ?y;?y suppliedBy ?z")
    return _rows(spark, [tuple(bgp.count_distinct(kb, v.split(), q) for v in ("?x", "?x ?y", "?x ?y ?z"))], "x long, xy long, xyz long")


@register("aggregated_counts", _KB + _DONE + "SELECT (SELECT count(*) FROM kb WHERE r = 'returned') AS n")
def _aggregated(spark: SparkSession, d: str) -> DataFrame:
    """The sum over a map of bindings to counts."""
    return bgp.count_bindings(derived_kb(spark, d), "?y", Atom("?x", "returned", "?y")).agg(F.sum("n").alias("n"))


_simple("cardinality_inverse_eq", lambda kb: bgp.compile_query(kb, _atoms("?x hasNumberOfValuesEqualsInv7 returned"), ["?x"]), "SELECT o AS x FROM kb WHERE r = 'returned' GROUP BY o HAVING count(*) = 7")
_simple("product_query", lambda kb: bgp.compile_query(kb, _atoms("?x inRegion ?y;c1 inNation ?z"), ["?x", "?z"], product=True), "SELECT DISTINCT a.s AS x, b.o AS z FROM kb a, kb b WHERE a.r = 'inRegion' AND b.s = 'c1' AND b.r = 'inNation'")
_simple(
    "count_projection_head_variable",
    lambda kb: bgp.count_projection_bindings(kb, Atom("?x", "bought", "?y"), _atoms("?x returned ?z"), "?y"),
    "SELECT o AS y, count(*) AS n FROM kb WHERE r = 'bought' AND s IN (SELECT s FROM kb WHERE r = 'returned') GROUP BY o",
)
_simple(
    "difference_4var",
    lambda kb: bgp.difference(kb, ["?x", "?y", "?z", "?w"], _atoms("?x returned ?y;?y suppliedBy ?z;?z inNation ?w"), _atoms("?x inNation ?w")),
    "SELECT a.s AS x, a.o AS y, b.o AS z, c.o AS w FROM (SELECT * FROM kb WHERE r = 'returned') a JOIN (SELECT * FROM kb WHERE r = 'suppliedBy') b ON a.o = b.s JOIN (SELECT * FROM kb WHERE r = 'inNation') c ON c.s = b.o ANTI JOIN (SELECT s, o FROM kb WHERE r = 'inNation') d ON d.s = a.s AND d.o = c.o",
)
_simple(
    "difference_4var_no_common",
    lambda kb: bgp.difference_no_vars_in_common(kb, ["?x", "?y", "?z", "?w"], _atoms("?x returned ?y;?y suppliedBy ?z;?z inNation ?w"), Atom("?x", "did", "?e")),
    "SELECT a.s AS x, a.o AS y, b.o AS z, c.o AS w FROM (SELECT * FROM kb WHERE r = 'returned') a JOIN (SELECT * FROM kb WHERE r = 'suppliedBy') b ON a.o = b.s JOIN (SELECT * FROM kb WHERE r = 'inNation') c ON c.s = b.o ANTI JOIN (SELECT s FROM kb WHERE r = 'did') d ON d.s = a.s",
)


# --- statistics


_simple(
    "overlap_report",
    stats.overlap_report,
    """x AS (SELECT DISTINCT r, s AS e FROM kb), y AS (SELECT DISTINCT r, o AS e FROM kb),
ss AS (SELECT a.r AS r1, b.r AS r2, count(*) AS ss FROM x a JOIN x b USING (e) WHERE a.r <> b.r GROUP BY 1, 2), so AS (SELECT a.r AS r1, b.r AS r2, count(*) AS so FROM x a JOIN y b USING (e) WHERE a.r <> b.r GROUP BY 1, 2),
os AS (SELECT a.r AS r1, b.r AS r2, count(*) AS os FROM y a JOIN x b USING (e) WHERE a.r <> b.r GROUP BY 1, 2), oo AS (SELECT a.r AS r1, b.r AS r2, count(*) AS oo FROM y a JOIN y b USING (e) WHERE a.r <> b.r GROUP BY 1, 2),
z AS (SELECT r, count(DISTINCT s) AS a, count(DISTINCT o) AS b FROM kb GROUP BY r)
SELECT r1, r2, coalesce(ss, 0) AS ss, coalesce(so, 0) AS so, coalesce(os, 0) AS os, coalesce(oo, 0) AS oo, p.a AS subjects1, p.b AS objects1, q.a AS subjects2, q.b AS objects2 FROM ss FULL JOIN so USING (r1, r2) FULL JOIN os USING (r1, r2) FULL JOIN oo USING (r1, r2) JOIN z p ON p.r = r1 JOIN z q ON q.r = r2""",
)
_simple("maximal_cardinality_unlimited", stats.maximal_cardinality, "SELECT r, max(deg) AS n FROM ds GROUP BY r", deg=True)
_simple("maximal_cardinality_inverse", lambda kb: stats.maximal_cardinality(kb, "o", 50), "SELECT r, coalesce(max(deg) FILTER (deg < 50), 50) AS n FROM dn GROUP BY r", deg=True)
_simple("occurrences_omitting", lambda kb: stats.occurrences(kb, omitted=["hasPart", "bought"]), "SELECT e, count(*) AS n FROM (SELECT s AS e, r FROM kb UNION ALL SELECT o, r FROM kb) WHERE r NOT IN ('hasPart', 'bought') GROUP BY e")
_simple("star_pairs_estimate", lambda kb: stats.star_pairs_estimate(kb, "returned"), "SELECT p - ceil(p * (1 - k::DOUBLE / n)) AS n FROM (SELECT sum(deg::DOUBLE * deg) AS p FROM dn WHERE r = 'returned'), (SELECT count(*) AS n, count(DISTINCT s) AS k FROM kb WHERE r = 'returned')", deg=True)
_simple(
    "star_pca_estimate",
    lambda kb: stats.star_pca_estimate(kb, "bought", "returned"),
    "SELECT facts - ceil(entities * (n::DOUBLE / k - 1))::BIGINT AS n FROM (SELECT count(*) AS facts, count(DISTINCT s) AS entities FROM kb WHERE r = 'bought' AND s IN (SELECT s FROM kb WHERE r = 'returned')), (SELECT count(*) AS n, count(DISTINCT s) AS k FROM kb WHERE r = 'bought')",
)
_simple("link_statistics", lambda kb: stats.link_statistics(kb, "returned"), "SELECT count(*) AS links, count(*) FILTER (EXISTS (SELECT 1 FROM kb k WHERE k.s = l.s AND k.o = l.o AND k.r <> 'returned')) AS semantified FROM kb l WHERE l.r = 'returned'")
for _name in ("overlap_report",):
    ORACLES[_name] = ORACLES[_name].replace("done AS (SELECT 1) x AS", "done AS (SELECT 1), x AS")


@register("typed_distribution", _KB + _META + _TYPES + " u AS (SELECT 'placedBy' AS r, e FROM t WHERE type = 'Order'), d AS (SELECT u.r, u.e, count(kb.o) AS deg FROM u LEFT JOIN kb ON kb.r = u.r AND kb.s = u.e GROUP BY 1, 2) SELECT r, deg, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM u) AS p FROM d GROUP BY 1, 2")
def _typed_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.typed_distribution(derived_kb(spark, d), derived_schema(spark, d)).filter("r = 'placedBy'")


@register("common_relations", _KB + _OLD + " a AS (SELECT r, count(*) AS n, count(DISTINCT s) AS x, count(DISTINCT o) AS y FROM old GROUP BY r), b AS (SELECT r, count(*) AS n, count(DISTINCT s) AS x, count(DISTINCT o) AS y FROM kb GROUP BY r) SELECT r, a.n AS size_a, a.x::DOUBLE / a.n AS functionality_a, a.y::DOUBLE / a.n AS inverse_functionality_a, b.n AS size_b, b.x::DOUBLE / b.n AS functionality_b, b.y::DOUBLE / b.n AS inverse_functionality_b FROM a JOIN b USING (r)")
def _common(spark: SparkSession, d: str) -> DataFrame:
    return stats.common_relations(derived_kb(spark, d, SPLIT), derived_kb(spark, d))


@register("declared_relations", "SELECT * FROM (VALUES ('function', 'placedBy'), ('mandatory', 'inNation')) t(kind, r)")
def _declared(spark: SparkSession, d: str) -> DataFrame:
    marks = _rows(spark, [("placedBy", "<isFunction>", "TRUE"), ("bought", "<isFunction>", "FALSE"), ("inNation", "<isMandatory>", "TRUE")], "s string, r string, o string")
    kb = derived_kb(spark, d).union(marks)
    return schema.declared(kb, "<isFunction>").select(F.lit("function").alias("kind"), "r").union(schema.declared(kb, "<isMandatory>").select(F.lit("mandatory"), "r"))


# --- schema

_UP = "WITH RECURSIVE" + _META + _CLOSURE


@register("signatures", "SELECT * FROM (VALUES ('placedBy', 'Order', 'Customer'), ('dealsWith', 'Party', NULL), ('boughtFrom', 'Party', NULL)) t(r, domain, range)")
def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return schema.signatures(derived_schema(spark, d))


@register("specific_types", "WITH RECURSIVE" + _META + _DONE + "SELECT DISTINCT s AS e, o AS type FROM meta WHERE r = 'rdf:type'")
def _specific(spark: SparkSession, d: str) -> DataFrame:
    """Of stated types and those that follow, the lowest."""
    meta = derived_schema(spark, d)
    return schema.most_specific_types(meta.union(schema.new_type_facts(meta)))


@register("all_types", _UP + " own AS (SELECT s, o FROM meta WHERE r = 'rdf:type') SELECT s AS e, o AS type FROM own UNION SELECT own.s, up.b FROM own JOIN up ON up.a = own.o")
def _all_types(spark: SparkSession, d: str) -> DataFrame:
    return schema.all_types(derived_schema(spark, d))


@register("leaf_types", "WITH RECURSIVE" + _META + _DONE + "SELECT o AS type FROM meta WHERE r = 'rdf:type' UNION SELECT s FROM meta WHERE r = 'rdfs:subClassOf' EXCEPT SELECT o FROM meta WHERE r = 'rdfs:subClassOf'")
def _leaf_types(spark: SparkSession, d: str) -> DataFrame:
    return schema.leaf_types(derived_schema(spark, d))


@register("super_and_sub_types", _UP + _DONE + "SELECT 'super' AS kind, b AS type FROM up WHERE a = 'Customer' UNION ALL SELECT 'sub', a FROM up WHERE b = 'Thing' UNION ALL SELECT 'direct super', o FROM meta WHERE r = 'rdfs:subClassOf' AND s = 'Customer' UNION ALL SELECT 'direct sub', s FROM meta WHERE r = 'rdfs:subClassOf' AND o = 'Thing'")
def _super_types(spark: SparkSession, d: str) -> DataFrame:
    meta = derived_schema(spark, d)
    parts = (("super", schema.super_types(meta, "Customer")), ("sub", schema.sub_types(meta, "Thing")), ("direct super", schema.super_types(meta, "Customer", False)), ("direct sub", schema.sub_types(meta, "Thing", False)))
    return reduce(DataFrame.union, [rows.select(F.lit(kind).alias("kind"), "type") for kind, rows in parts])


@register("one_step_super_types", "SELECT * FROM (VALUES ('Party', 'Customer', true), ('Thing', 'Customer', false), ('Customer', 'Party', false)) t(parent, child, yes)")
def _one_step(spark: SparkSession, d: str) -> DataFrame:
    meta = derived_schema(spark, d)
    return _rows(spark, [(p, c, schema.is_super_type(meta, p, c)) for p, c in (("Party", "Customer"), ("Thing", "Customer"), ("Customer", "Party"))], "parent string, child string, yes boolean")


@register("domain_and_range_sets", _KB + _META + _TYPES + " x AS (SELECT e FROM t WHERE type = 'Customer'), y AS (SELECT DISTINCT o AS e FROM kb WHERE r = 'placedBy') SELECT 'domain' AS side, e FROM (SELECT e FROM t WHERE type = 'Order' UNION SELECT s FROM kb WHERE r = 'placedBy') UNION ALL SELECT 'range', e FROM (SELECT e FROM x UNION SELECT e FROM y) UNION ALL SELECT 'both', e FROM x SEMI JOIN y USING (e)")
def _sides(spark: SparkSession, d: str) -> DataFrame:
    kb, meta = derived_kb(spark, d), derived_schema(spark, d)
    parts = (("domain", schema.side_set(kb, meta, "placedBy")), ("range", schema.side_set(kb, meta, "placedBy", "o")), ("both", schema.side_set(kb, meta, "placedBy", "o", both=True)))
    return reduce(DataFrame.union, [rows.select(F.lit(kind).alias("side"), "e") for kind, rows in parts])


@register("second_level_types", "SELECT * FROM (VALUES ('Agent')) t(type)")
def _second_level(spark: SparkSession, d: str) -> DataFrame:
    """With a hierarchy of three levels beside the derived one, whose types are all in a cycle."""
    more = _rows(spark, [("Buyer", "rdfs:subClassOf", "Agent"), ("Seller", "rdfs:subClassOf", "Agent"), ("Agent", "rdfs:subClassOf", "Being")], "s string, r string, o string")
    return schema.second_level_types(derived_schema(spark, d).union(more))


@register("kept_types", "WITH RECURSIVE" + _META + _DONE + "SELECT s, r, o FROM meta WHERE r <> 'rdf:type' OR o IN ('Part', 'Nation')")
def _kept_types(spark: SparkSession, d: str) -> DataFrame:
    return schema.keep_types(derived_schema(spark, d), _rows(spark, [("Part",), ("Nation",)], "type string"))


@register("lifted_types", _UP + " inner_(t) AS (SELECT o FROM meta WHERE r = 'rdfs:subClassOf') SELECT DISTINCT m.s, m.r, up.b AS o FROM meta m JOIN up ON up.a = m.o WHERE m.r = 'rdf:type' AND m.o NOT IN (SELECT t FROM inner_) UNION SELECT s, r, o FROM meta WHERE r <> 'rdf:type'")
def _lifted(spark: SparkSession, d: str) -> DataFrame:
    meta = derived_schema(spark, d)
    return schema.lift_leaf_types(meta, meta)


@register("facts_with_types", _KB + _META + _CLOSURE + " own AS (SELECT s, o FROM meta WHERE r = 'rdf:type'), every AS (SELECT s, o FROM own UNION SELECT own.s, up.b FROM own JOIN up ON up.a = own.o) SELECT s, r, o FROM kb UNION SELECT s, 'rdf:type', o FROM every WHERE s IN (SELECT s FROM kb UNION SELECT o FROM kb)")
def _facts_with_types(spark: SparkSession, d: str) -> DataFrame:
    return schema.join_all_types(derived_kb(spark, d), derived_schema(spark, d))


# --- scalar functions


@register("text_functions", """SELECT s, '"' || o || '"' AS quoted, '<' || s || '>' AS wrapped, '&lt;' || s || '&gt; &amp; co' AS html, replace(o, '#', '_') AS name, true AS plain_ascii, s || ' x+y' AS url, '"12"' AS literal FROM (SELECT 'p' || p_partkey AS s, p_brand AS o FROM part)""")
def _text_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("s"), F.col("p_brand").alias("o"))
    return rows.select(
        "s",
        text.quote_literal(F.col("o")).alias("quoted"),
        text.wrap_entity(F.col("s")).alias("wrapped"),
        text.html_escape(F.concat(F.lit("<"), "s", F.lit("> & co"))).alias("html"),
        text.identifier(F.col("o")).alias("name"),
        text.is_ascii(F.col("o")).alias("plain_ascii"),
        text.url_unquote(F.concat("s", F.lit("%20x+y"))).alias("url"),
        text.cut_datatype(F.lit('"12"^^xsd:integer')).alias("literal"),
    )


# --- filters, sets and samples


@register("pair_difference", _KB + _DONE + "SELECT a.s AS c0, 'x' AS c1, a.o AS c2 FROM (SELECT s, o, least(s, o) AS lo, greatest(s, o) AS hi FROM kb WHERE r = 'boughtFrom') a ANTI JOIN (SELECT least(s, o) AS lo, greatest(s, o) AS hi FROM kb WHERE r = 'soldTo') b USING (lo, hi)")
def _pair_difference(spark: SparkSession, d: str) -> DataFrame:
    kb = derived_kb(spark, d)
    cut = lambda r: kb.filter(F.col("r") == r).select(F.col("s").alias("c0"), F.lit("x").alias("c1"), F.col("o").alias("c2"))
    return setops.pair_difference(cut("boughtFrom"), cut("soldTo"))


_simple(
    "combined_relevance",
    lambda kb: setops.relevance(kb, kb.filter("r = 'hasPart'").groupBy(F.col("s").alias("e")).agg((F.count("*") * 10).alias("n")), kb.filter("r = 'placedBy'").groupBy(F.col("o").alias("e")).agg(F.count("*").alias("n"))).select("e", F.round("relevance", 6).alias("relevance")),
    "SELECT e, round(log10(coalesce(l.n, 2)) * coalesce(k.n, 2) * f.n, 6) AS relevance FROM (SELECT e, count(*) AS n FROM (SELECT s AS e FROM kb UNION ALL SELECT o FROM kb) GROUP BY e) f LEFT JOIN (SELECT s AS e, count(*) * 10 AS n FROM kb WHERE r = 'hasPart' GROUP BY s) l USING (e) LEFT JOIN (SELECT o AS e, count(*) AS n FROM kb WHERE r = 'placedBy' GROUP BY o) k USING (e)",
)
_simple("language_codes", lambda kb: setops.drop_language_codes(kb, "did"), "SELECT s, r, o FROM kb WHERE r <> 'did'")
_simple(
    "living_dead",
    lambda kb: setops.drop_living_dead(kb, "sg_BUILDING", "returned", "inSegment"),
    "SELECT k.s, k.r, k.o FROM kb k LEFT JOIN (SELECT DISTINCT s FROM kb WHERE r = 'returned') d ON d.s = k.s WHERE k.r <> 'inSegment' OR k.o <> 'sg_BUILDING' OR d.s IS NULL",
)
_simple("swapped_facts", setops.swap, "SELECT o AS s, r, s AS o FROM kb")
_simple("kept_relations", lambda kb: setops.keep_relations(kb, ["inNation", "did"]), "SELECT s, r, o FROM kb WHERE r IN ('inNation', 'did')")
_simple(
    "substituted_labels",
    lambda kb: setops.substitute(kb, "o", kb.filter("r = 'inRegion'").select(F.col("s").alias("id"), F.col("o").alias("name"))),
    "SELECT k.s, k.r, coalesce(m.o, k.o) AS o FROM kb k LEFT JOIN (SELECT s, o FROM kb WHERE r = 'inRegion') m ON m.s = k.o",
)
_simple(
    "neighbourhood",
    lambda kb: setops.neighbourhood(kb.filter("r in ('inNation', 'inRegion', 'neighbour')"), kb.sparkSession.createDataFrame([("n3",)], "e string"), 2),
    """e AS (SELECT s AS a, o AS b FROM kb WHERE r IN ('inNation', 'inRegion', 'neighbour') UNION SELECT o, s FROM kb WHERE r IN ('inNation', 'inRegion', 'neighbour')), one AS (SELECT 'n3' AS x UNION SELECT b FROM e WHERE a = 'n3'), two AS (SELECT x FROM one UNION SELECT b FROM e JOIN one ON a = x)
SELECT s, r, o FROM kb WHERE r IN ('inNation', 'inRegion', 'neighbour') AND s IN (SELECT x FROM two) AND o IN (SELECT x FROM two)""",
)
ORACLES["neighbourhood"] = ORACLES["neighbourhood"].replace("done AS (SELECT 1) e AS", "done AS (SELECT 1), e AS")


@register("change_facts", _KB + _OLD + " a AS (SELECT r, s, list_sort(list(o)) AS x FROM old GROUP BY 1, 2), b AS (SELECT r, s, list_sort(list(o)) AS y FROM kb GROUP BY 1, 2) SELECT s, CASE WHEN x = y THEN '<hasNotChanged>' ELSE '<hasChanged>' END AS r, r AS o FROM a JOIN b USING (r, s)")
def _change_facts(spark: SparkSession, d: str) -> DataFrame:
    return setops.change_facts(derived_kb(spark, d, SPLIT), derived_kb(spark, d))


@register("coalesced_with_objects", _KB + _OLD + _OTHER + " k AS (SELECT DISTINCT s FROM other WHERE s IN (SELECT s FROM old UNION SELECT o FROM old)), m AS (SELECT DISTINCT o AS s FROM other WHERE s IN (SELECT s FROM k) AND o NOT IN (SELECT s FROM k)) SELECT s, r, o FROM old SEMI JOIN k USING (s) UNION SELECT s, r, o FROM other SEMI JOIN k USING (s) UNION SELECT s, r, o FROM other SEMI JOIN m USING (s)")
def _coalesced(spark: SparkSession, d: str) -> DataFrame:
    return setops.coalesce(derived_kb(spark, d, SPLIT), derived_other(spark, d), with_objects=True)


_TYPED = _KB + _META + _TYPES


@register("signed_relations", _TYPED + " done AS (SELECT 1) SELECT kb.r, a.type AS domain, b.type AS range, count(*) AS n FROM kb JOIN t a ON a.e = kb.s JOIN t b ON b.e = kb.o GROUP BY 1, 2, 3")
def _signed(spark: SparkSession, d: str) -> DataFrame:
    return setops.signed_relations(derived_kb(spark, d), schema.materialised_types(derived_schema(spark, d)))


@register("signed_overlaps", _TYPED + """ f AS (SELECT kb.r, kb.s, kb.o, a.type AS domain, b.type AS range FROM kb JOIN t a ON a.e = kb.s JOIN t b ON b.e = kb.o), big AS (SELECT r, domain, range FROM f GROUP BY 1, 2, 3 HAVING count(*) >= 3),
v AS (SELECT p.r AS r1, q.r AS r2, p.domain, p.range, count(*) AS overlap FROM f p JOIN f q ON p.s = q.s AND p.o = q.o AND p.r <> q.r GROUP BY ALL HAVING count(*) > 1), u AS (SELECT DISTINCT s, r AS other FROM kb), w AS (SELECT f.r, domain, range, other, count(*) AS n FROM f JOIN u USING (s) GROUP BY ALL)
SELECT v.r1, v.r2, v.domain, v.range, v.overlap, v.overlap::DOUBLE / w1.n AS pca1, v.overlap::DOUBLE / w2.n AS pca2 FROM v JOIN w w1 ON w1.r = r1 AND w1.other = r2 AND w1.domain = v.domain AND w1.range = v.range JOIN w w2 ON w2.r = r2 AND w2.other = r1 AND w2.domain = v.domain AND w2.range = v.range SEMI JOIN big b1 ON b1.r = r1 AND b1.domain = v.domain AND b1.range = v.range SEMI JOIN big b2 ON b2.r = r2 AND b2.domain = v.domain AND b2.range = v.range""")
def _signed_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return setops.signed_overlaps(derived_kb(spark, d), schema.materialised_types(derived_schema(spark, d)))


@register("types_of_subjects", _KB + _META + " done AS (SELECT 1) SELECT s, r, o FROM meta WHERE r = 'rdf:type' AND o IN ('Customer', 'Part') AND s IN (SELECT s FROM kb)")
def _types_of_subjects(spark: SparkSession, d: str) -> DataFrame:
    return setops.join_types(derived_kb(spark, d), derived_schema(spark, d).filter("r = 'rdf:type'").select("s", "o"), ["Customer", "Part"])


@register("links_between_entities", _KB + _OLD + " u AS (SELECT s AS e FROM old UNION SELECT o FROM old) SELECT s, r, o FROM kb WHERE r = 'bought' AND s IN (SELECT e FROM u) AND o IN (SELECT e FROM u)")
def _links(spark: SparkSession, d: str) -> DataFrame:
    return setops.join_links(derived_kb(spark, d, SPLIT), derived_kb(spark, d).filter("r = 'bought'"), both=True)


# --- mining


_NATIVE = "CASE WHEN inv THEN '?h1  ' || b || '  ?h0' ELSE '?h0  ' || b || '  ?h1' END || '   => ?h0  ' || h || '  ?h1' AS rule"
_E = "e AS (SELECT r || '+' AS l, s AS a, o AS b FROM kb UNION ALL SELECT r || '-', o, s FROM kb)"
_INV = "replace(replace(replace({0}, '+', '*'), '-', '+'), '*', '-')"
_TWO_ALL = f"""st AS (SELECT r, count(*) AS n, count(DISTINCT s) AS ns, count(DISTINCT o) AS no, count(DISTINCT s) >= count(DISTINCT o) AS f FROM kb GROUP BY r), {_E},
two AS (SELECT h.r AS h, e.l, count(*) AS support FROM kb h JOIN e ON e.a = h.s AND e.b = h.o WHERE e.l <> h.r || '+' GROUP BY 1, 2),
ds AS (SELECT DISTINCT r, s AS x FROM kb), dn AS (SELECT DISTINCT r, o AS x FROM kb),
body2 AS (SELECT two.h, two.l, count(*) AS body_size, count(*) FILTER (CASE WHEN f THEN ds.x ELSE dn.x END IS NOT NULL) AS pca FROM two JOIN st ON st.r = two.h JOIN e ON e.l = two.l LEFT JOIN ds ON ds.r = two.h AND ds.x = e.a LEFT JOIN dn ON dn.r = two.h AND dn.x = e.b GROUP BY 1, 2)"""
_ATOM = "CASE WHEN {0} LIKE '%+' THEN '{1}|' || left({0}, -1) || '|{2}' ELSE '{2}|' || left({0}, -1) || '|{1}' END"
_MEASURES = "support::DOUBLE / n AS head_coverage, support::DOUBLE / body_size AS std_confidence, support::DOUBLE / pca AS pca_confidence, support, body_size, pca AS pca_body_size, CASE WHEN f THEN '?a' ELSE '?b' END AS functional_variable"

ORACLES["mine_closed_rules_skyline"] = f"""{_KB} {_TWO_ALL},
c2 AS (SELECT two.*, body_size, pca, n, f FROM two JOIN body2 USING (h, l) JOIN st ON st.r = two.h WHERE n >= 100 AND support >= ceil(0.01 * n)),
twin AS (SELECT h.r AS h, p.l AS l1, q.l AS l2, count(*) AS support FROM kb h JOIN e p ON p.a = h.s AND p.b = h.o JOIN e q ON q.a = h.s AND q.b = h.o AND q.l > p.l WHERE p.l <> h.r || '+' AND q.l <> h.r || '+' GROUP BY 1, 2, 3),
twinbody AS (SELECT twin.h, l1, l2, count(*) AS body_size, count(*) FILTER (CASE WHEN f THEN ds.x ELSE dn.x END IS NOT NULL) AS pca FROM twin JOIN st ON st.r = twin.h JOIN e p ON p.l = l1 JOIN e q ON q.l = l2 AND q.a = p.a AND q.b = p.b LEFT JOIN ds ON ds.r = twin.h AND ds.x = p.a LEFT JOIN dn ON dn.r = twin.h AND dn.x = p.b GROUP BY 1, 2, 3),
c3 AS (SELECT twin.*, twinbody.body_size, twinbody.pca, st.n, st.f FROM twin JOIN twinbody USING (h, l1, l2) JOIN st ON st.r = twin.h JOIN c2 x ON x.h = twin.h AND x.l = l1 JOIN c2 y ON y.h = twin.h AND y.l = l2
  WHERE st.n >= 100 AND twin.support >= ceil(0.01 * st.n) AND twin.support::DOUBLE / twinbody.pca > x.support::DOUBLE / x.pca AND twin.support::DOUBLE / twinbody.pca > y.support::DOUBLE / y.pca),
fan AS (SELECT a, count(*) AS deg FROM e GROUP BY a), heads AS (SELECT kb.r AS h, s AS x, o AS y, p.deg <= q.deg AS from_x FROM kb JOIN fan p ON p.a = s JOIN fan q ON q.a = o JOIN st ON st.r = kb.r WHERE st.n >= 100),
near_x AS MATERIALIZED (SELECT h, x, y, l AS lx, b AS z FROM heads JOIN e ON a = x WHERE from_x), near_y AS MATERIALIZED (SELECT h, x, y, l AS ly, b AS z FROM heads JOIN e ON a = y WHERE NOT from_x),
hits AS (SELECT h, x, y, lx, e.l AS ly FROM near_x JOIN e ON e.a = y AND e.b = z UNION SELECT h, x, y, e.l, ly FROM near_y JOIN e ON e.a = x AND e.b = z),
tri AS (SELECT h, lx, ly, count(*) AS support FROM hits GROUP BY 1, 2, 3),
mid AS (SELECT tri.*, n, f, CASE WHEN f THEN lx ELSE ly END AS m1, CASE WHEN f THEN {_INV.format('ly')} ELSE {_INV.format('lx')} END AS m2 FROM tri JOIN st ON st.r = h WHERE support >= ceil(0.01 * n)),
d AS (SELECT l, a, count(*) AS deg FROM e GROUP BY 1, 2), pairs AS (SELECT DISTINCT m1, m2 FROM mid), reach AS (SELECT m1, m2, e.a AS u, max(deg) AS least FROM pairs JOIN e ON e.l = m1 JOIN d ON d.l = m2 AND d.a = e.b GROUP BY 1, 2, 3),
own AS (SELECT r, true AS f, x FROM ds UNION ALL SELECT r, false, x FROM dn),
low AS (SELECT mid.h, lx, ly, sum(least) AS low FROM mid JOIN reach USING (m1, m2) JOIN own ON own.r = mid.h AND own.f = mid.f AND own.x = u GROUP BY 1, 2, 3),
left_ AS (SELECT mid.* FROM mid JOIN low USING (h, lx, ly) WHERE support >= 0.1 * low), todo AS (SELECT DISTINCT m1, m2 FROM left_), first_ AS MATERIALIZED (SELECT m1, m2, a AS u, b AS z FROM todo JOIN e ON l = m1),
reached AS (SELECT DISTINCT m1, m2, u, b AS w FROM first_ JOIN e ON l = m2 AND a = z), per AS (SELECT m1, m2, u, count(*) AS n FROM reached GROUP BY 1, 2, 3),
sizes AS (SELECT left_.h, lx, ly, sum(per.n)::BIGINT AS body_size, (sum(per.n) FILTER (own.x IS NOT NULL))::BIGINT AS pca FROM left_ JOIN per USING (m1, m2) LEFT JOIN own ON own.r = left_.h AND own.f = left_.f AND own.x = u GROUP BY 1, 2, 3),
c4 AS (SELECT left_.*, body_size, pca FROM left_ JOIN sizes USING (h, lx, ly)),
shown AS (
  SELECT {_ATOM.format('l', '?h0', '?h1')} AS body, h, support, n, body_size, pca, f FROM c2
  UNION ALL SELECT least({_ATOM.format('l1', '?h0', '?h1')}, {_ATOM.format('l2', '?h0', '?h1')}) || '  ' || greatest({_ATOM.format('l1', '?h0', '?h1')}, {_ATOM.format('l2', '?h0', '?h1')}), h, support, n, body_size, pca, f FROM c3
  UNION ALL SELECT least({_ATOM.format('lx', '?h0', '?v0')}, {_ATOM.format('ly', '?h1', '?v0')}) || '  ' || greatest({_ATOM.format('lx', '?h0', '?v0')}, {_ATOM.format('ly', '?h1', '?v0')}), h, support, n, body_size, pca, f FROM c4)
SELECT replace(body, '|', '  ') || '   => ?h0  ' || h || '  ?h1' AS rule, {_MEASURES} FROM shown WHERE support >= 0.1 * pca"""


@register("mine_head_targets", f"{_KB} {_TWO_ALL}, ok AS (SELECT two.h, left(two.l, -1) AS b, two.l LIKE '%-' AS inv, support, body_size, pca, n, f FROM two JOIN body2 USING (h, l) JOIN st ON st.r = two.h WHERE two.h IN ('boughtFrom', 'returned') AND support >= ceil(0.01 * n)) SELECT {_NATIVE}, {_MEASURES} FROM ok WHERE support >= 0.1 * pca")
def _head_targets(spark: SparkSession, d: str) -> DataFrame:
    return miner.mine(derived_kb(spark, d), miner.Config(max_atoms=2, head_targets=frozenset(["boughtFrom", "returned"])))


@register("mine_without_std", f"{_KB} {_TWO_ALL}, ok AS (SELECT two.h, left(two.l, -1) AS b, two.l LIKE '%-' AS inv, support, 2 * support AS body_size, pca, n, f FROM two JOIN body2 USING (h, l) JOIN st ON st.r = two.h WHERE n >= 1000 AND support >= 500 AND left(two.l, -1) IN ('bought', 'soldTo')) SELECT {_NATIVE}, {_MEASURES} FROM ok WHERE support >= 0.1 * pca")
def _without_std(spark: SparkSession, d: str) -> DataFrame:
    """An absolute support, body relations given, standard confidence left out."""
    return miner.mine(derived_kb(spark, d), miner.Config(max_atoms=2, prune_by="support", min_support=500, min_head_size=1000, omit_std=True, body_targets=frozenset(["bought", "soldTo"])))


@register("mine_one_variable", f"""{_KB} {_TWO_ALL},
v AS (SELECT h.r AS h, e.l, st.f, count(DISTINCT CASE WHEN f THEN h.s ELSE h.o END) AS support, any_value(CASE WHEN f THEN ns ELSE no END) AS n FROM kb h JOIN st ON st.r = h.r JOIN e ON e.a = h.s AND e.b = h.o WHERE e.l <> h.r || '+' GROUP BY 1, 2, 3),
w AS (SELECT v.h, v.l, count(DISTINCT CASE WHEN f THEN e.a ELSE e.b END) AS body_size, count(DISTINCT CASE WHEN f THEN ds.x ELSE dn.x END) AS pca FROM v JOIN e ON e.l = v.l LEFT JOIN ds ON ds.r = v.h AND ds.x = e.a LEFT JOIN dn ON dn.r = v.h AND dn.x = e.b GROUP BY 1, 2),
ok AS (SELECT v.h, left(v.l, -1) AS b, v.l LIKE '%-' AS inv, support, body_size, pca, n, f FROM v JOIN w USING (h, l) WHERE n >= 100 AND support >= ceil(0.01 * n)) SELECT {_NATIVE}, {_MEASURES} FROM ok WHERE support >= 0.1 * pca""")
def _one_variable(spark: SparkSession, d: str) -> DataFrame:
    return miner.rules_frame(spark, biases.mine_one_variable(derived_kb(spark, d), miner.Config(max_atoms=2)))


_CONSTANTS = ("inSegment", "inNation", "hasBrand")


@register("mine_constants", f"""{_KB} part_ AS (SELECT * FROM kb WHERE r IN ('inSegment', 'inNation')), st AS (SELECT r, count(*) AS n, count(DISTINCT s) >= count(DISTINCT o) AS f FROM part_ GROUP BY r),
big AS (SELECT r, o, count(*) AS k FROM part_ GROUP BY 1, 2), hits AS (SELECT h.r AS h, h.o AS c, b.r AS b, b.o AS k, count(*) AS support FROM part_ h JOIN part_ b ON b.s = h.s AND (b.r, b.o) <> (h.r, h.o) GROUP BY 1, 2, 3, 4),
ok AS (SELECT hits.*, n, bb.k AS body_size FROM hits JOIN st ON st.r = hits.h JOIN big hh ON hh.r = hits.h AND hh.o = hits.c JOIN big bb ON bb.r = hits.b AND bb.o = hits.k WHERE n >= 100 AND hh.k >= ceil(0.01 * n) AND support >= ceil(0.01 * n) AND support >= 2),
pca AS (SELECT ok.h, c, b, ok.k, count(*) FILTER (m.s IN (SELECT s FROM part_ p WHERE p.r = ok.h)) AS pca FROM ok JOIN part_ m ON m.r = ok.b AND m.o = ok.k GROUP BY 1, 2, 3, 4)
SELECT '?h0  ' || b || '  ' || k || '   => ?h0  ' || h || '  ' || c AS rule, support::DOUBLE / n AS head_coverage, support::DOUBLE / body_size AS std_confidence, support::DOUBLE / pca AS pca_confidence, support, body_size, pca AS pca_body_size, '?a' AS functional_variable
FROM ok JOIN pca USING (h, c, b, k) WHERE support >= 0.1 * pca""")
def _mine_constants(spark: SparkSession, d: str) -> DataFrame:
    """Instantiated heads and bodies of two relations: rules of two atoms about one variable."""
    kb = derived_kb(spark, d).filter("r in ('inSegment', 'inNation')")
    return miner.rules_frame(spark, biases.constant_rules(kb))


@register("specialised_types", "SELECT * FROM (VALUES ('rdf:type(?x,Customer) => bought(?x,?y)'), ('rdf:type(?x,Supplier) => bought(?x,?y)'), ('rdf:type(?x,Thing) => bought(?x,?y)')) t(rule)")
def _specialised(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule(Atom("?x", "bought", "?y"), (Atom("?x", "rdf:type", "Party"),))
    return _rows(spark, [(terms.datalog_text(r),) for r in biases.specialised_types(derived_schema(spark, d), rule)], "rule string")


@register("triangle_supports", f"""{_KB} {_E}, fan AS (SELECT a, count(*) AS deg FROM e GROUP BY a), heads AS (SELECT kb.r AS h, s AS x, o AS y, p.deg <= q.deg AS from_x FROM kb JOIN fan p ON p.a = s JOIN fan q ON q.a = o),
near_x AS MATERIALIZED (SELECT h, x, y, l AS lx, b AS z FROM heads JOIN e ON a = x WHERE from_x), near_y AS MATERIALIZED (SELECT h, x, y, l AS ly, b AS z FROM heads JOIN e ON a = y WHERE NOT from_x),
hits AS (SELECT h, x, y, lx, e.l AS ly FROM near_x JOIN e ON e.a = y AND e.b = z UNION SELECT h, x, y, e.l, ly FROM near_y JOIN e ON e.a = x AND e.b = z)
SELECT h AS head, lx, ly, count(*) AS n FROM hits GROUP BY 1, 2, 3""")
def _triangles(spark: SparkSession, d: str) -> DataFrame:
    """Supports of all rules of three atoms over three variables, all relations and directions at once."""
    kb = metrics.coded(derived_kb(spark, d))
    return metrics.triangle_counts(kb, [r["r"] for r in kb.select("r").distinct().collect()])  # a row per relation


@register("confidence_bounds", f"""{_KB} {_E}, d AS (SELECT l, a, count(*) AS deg FROM e GROUP BY 1, 2),
reach AS (SELECT e.a AS u, max(deg) AS low, sum(deg) AS high FROM e JOIN d ON d.l = 'suppliedBy+' AND d.a = e.b WHERE e.l = 'bought+' GROUP BY 1)
SELECT sum(low)::BIGINT AS low, sum(high)::BIGINT AS high, (sum(low) FILTER (u IN (SELECT s FROM kb WHERE r = 'boughtFrom')))::BIGINT AS pca_low, (sum(high) FILTER (u IN (SELECT s FROM kb WHERE r = 'boughtFrom')))::BIGINT AS pca_high FROM reach""")
def _bounds(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.path_bounds(spark, derived_kb(spark, d), [(0, parse_rule(TRAINED[0]))])
    return _rows(spark, [got[0]], "low long, high long, pca_low long, pca_high long")


@register("path_estimates", f"""{_KB} st AS (SELECT r, count(*) AS n, count(DISTINCT s) AS a, count(DISTINCT o) AS b FROM kb GROUP BY r), p AS (SELECT * FROM st WHERE r = 'bought'), q AS (SELECT * FROM st WHERE r = 'suppliedBy'),
x AS (SELECT count(*) AS k FROM (SELECT s FROM kb WHERE r = 'boughtFrom' INTERSECT SELECT s FROM kb WHERE r = 'bought')), y AS (SELECT count(*) AS k FROM (SELECT o FROM kb WHERE r = 'bought' INTERSECT SELECT s FROM kb WHERE r = 'suppliedBy'))
SELECT round(1000 / (x.k * (p.n::DOUBLE / p.a) * (y.k::DOUBLE / p.b) * (q.n::DOUBLE / q.a) * (q.b::DOUBLE / q.n)), 9) AS estimate FROM p, q, x, y""")
def _estimates(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    found = miner.Miner(derived_kb(spark, d), miner.lossy_vanilla())
    return _rows(spark, [(round(found.estimator()(replace(parse_rule(TRAINED[0]), support=1000.0)), 9),)], "estimate double")


@register("signature_typed_rules", _KB + _META + _TYPES + """ b AS (SELECT s AS x, o AS y FROM kb WHERE r = 'did' AND s IN (SELECT e FROM t WHERE type = 'Customer')) SELECT 'x' AS k, count(*) AS body_size FROM (SELECT a.s FROM kb a JOIN t o ON o.e = a.s AND o.type = 'Order' JOIN t c ON c.e = a.o AND c.type = 'Customer' WHERE a.r = 'placedBy')""")
def _signature_typed(spark: SparkSession, d: str) -> DataFrame:
    found = biases.with_signature_types(derived_kb(spark, d), derived_schema(spark, d), [parse_rule("placedBy(?x,?y) => placedBy(?x,?y)")])
    return _rows(spark, [("x", r.body_size) for r in found], "k string, body_size long")


@register("typed_heads", _TYPED + """ z AS (SELECT r, ceil(0.01 * count(*)) AS least FROM kb GROUP BY r), o AS (SELECT kb.r, kb.s, kb.o, t.type AS range FROM kb JOIN t ON t.e = kb.o),
u AS (SELECT r, t.type AS domain, range, count(*) AS support FROM o JOIN t ON t.e = o.s GROUP BY 1, 2, 3 UNION ALL SELECT r, NULL, range, count(*) FROM o GROUP BY 1, 3 UNION ALL SELECT kb.r, t.type, NULL, count(*) FROM kb JOIN t ON t.e = kb.s WHERE kb.r NOT IN (SELECT r FROM o) GROUP BY 1, 2)
SELECT u.* FROM u JOIN z USING (r) WHERE support >= least""")
def _typed_heads(spark: SparkSession, d: str) -> DataFrame:
    return biases.typed_heads(derived_kb(spark, d), schema.materialised_types(derived_schema(spark, d)))


@register("shared_type_pca", _TYPED + " b AS (SELECT o AS x, s AS y FROM kb WHERE r = 'boughtFrom' AND o IN (SELECT s FROM kb WHERE r = 'soldTo')), alike AS (SELECT DISTINCT x, y FROM b JOIN t p ON p.e = x JOIN t q ON q.e = y AND q.type = p.type) SELECT CASE WHEN (SELECT count(*) FROM alike) > 0 THEN (SELECT count(*) FROM alike) ELSE (SELECT count(*) FROM b) END AS pca_body_size")
def _shared_type(spark: SparkSession, d: str) -> DataFrame:
    return biases.shared_type_pca(derived_kb(spark, d), schema.materialised_types(derived_schema(spark, d)), parse_rule("boughtFrom(?y,?x) => soldTo(?x,?y)"))


@register("instantiated_head_rules", f"""{_KB} st AS (SELECT r, count(DISTINCT s) >= count(DISTINCT o) AS f FROM kb GROUP BY r), h AS (SELECT r, CASE WHEN f THEN 's' ELSE 'o' END AS counted, CASE WHEN f THEN s ELSE o END AS e, CASE WHEN f THEN o ELSE s END AS constant FROM kb JOIN st USING (r)),
big AS (SELECT r, constant FROM h GROUP BY 1, 2 HAVING count(*) >= 100), has AS (SELECT DISTINCT r AS body, 's' AS side, s AS e FROM kb UNION ALL SELECT DISTINCT r, 'o', o FROM kb), z AS (SELECT body, side, count(*) AS body_size FROM has GROUP BY 1, 2),
g AS (SELECT h.r, counted, constant, body, side, count(*) AS support FROM h SEMI JOIN big USING (r, constant) JOIN has USING (e) WHERE NOT (h.r = body AND counted = side) GROUP BY ALL HAVING count(*) >= 100) SELECT g.*, body_size, support::DOUBLE / body_size AS std_confidence FROM g JOIN z USING (body, side)""")
def _instantiated(spark: SparkSession, d: str) -> DataFrame:
    return biases.instantiated_head_rules(derived_kb(spark, d), 100)


_TRUTH = " truth AS (SELECT s AS e, 'returned' AS target, CASE WHEN substr(md5(s), 1, 1) < '8' THEN true ELSE false END AS complete FROM meta WHERE r = 'rdf:type' AND o IN ('Customer', 'Supplier')),"
_HEADS = "SELECT {0}, 'isComplete' AS head, yes AS support, no AS against FROM g UNION ALL SELECT {0}, 'isIncomplete', no, yes FROM g"


def _truth(meta: DataFrame) -> DataFrame:
    return meta.filter("r = 'rdf:type' and o in ('Customer', 'Supplier')").select(F.col("s").alias("e"), F.lit("returned").alias("r"), (F.substring(F.md5("s"), 1, 1) < "8").alias("complete"))


@register("completeness_rules", _TYPED + _TRUTH + f""" deg AS (SELECT truth.*, (SELECT count(*) FROM kb WHERE kb.s = truth.e AND kb.r = 'returned') AS deg FROM truth), steps AS (SELECT unnest(range(0, (SELECT max(deg) + 1 FROM deg))) AS n),
hist AS (SELECT deg, complete, count(*) AS c FROM deg GROUP BY 1, 2), b AS (
  SELECT 'hasNumberOfValuesGreaterThan' || n AS body, complete, c FROM hist JOIN steps ON n < deg UNION ALL SELECT 'hasNumberOfValuesSmallerThan' || n, complete, c FROM hist JOIN steps ON n > deg
  UNION ALL SELECT 'type ' || type, complete, 1 FROM truth JOIN t USING (e) UNION ALL SELECT 'not type ' || k.type, complete, 1 FROM truth, (SELECT DISTINCT type FROM truth JOIN t USING (e)) k WHERE (truth.e, k.type) NOT IN (SELECT (e, type) FROM t)
  UNION ALL SELECT 'exists ' || r, complete, 1 FROM truth JOIN (SELECT DISTINCT s AS e, r FROM kb WHERE r <> 'returned') USING (e)),
g AS (SELECT 'returned' AS target, body, coalesce(sum(c) FILTER (complete), 0)::BIGINT AS yes, coalesce(sum(c) FILTER (NOT complete), 0)::BIGINT AS no FROM b GROUP BY body), u AS ({_HEADS.format('target, body')}) SELECT *, support::DOUBLE / (support + against) AS confidence FROM u WHERE support >= 20""")
def _completeness(spark: SparkSession, d: str) -> DataFrame:
    meta = derived_schema(spark, d)
    return biases.completeness_rules(derived_kb(spark, d), _truth(meta), meta, 20)


@register("star_completeness_rules", _TYPED + _TRUTH + f" b AS (SELECT 'exists ' || r AS body, complete FROM truth JOIN (SELECT DISTINCT s AS e, r FROM kb WHERE r <> 'returned') USING (e)), g AS (SELECT 'returned' AS target, body, count(*) FILTER (complete) AS yes, count(*) FILTER (NOT complete) AS no FROM b GROUP BY body), u AS ({_HEADS.format('target, body')}) SELECT *, support::DOUBLE / (support + against) AS confidence FROM u WHERE support >= 20")
def _star_completeness(spark: SparkSession, d: str) -> DataFrame:
    meta = derived_schema(spark, d)
    return biases.star_completeness_rules(derived_kb(spark, d), _truth(meta), meta, 20)


@register("completeness_pairs", _TYPED + _TRUTH + f" b AS (SELECT type, r, complete FROM truth JOIN t USING (e) JOIN (SELECT DISTINCT s AS e, r FROM kb WHERE r <> 'returned') USING (e)), g AS (SELECT 'returned' AS target, type, r, count(*) FILTER (complete) AS yes, count(*) FILTER (NOT complete) AS no FROM b GROUP BY type, r), u AS ({_HEADS.format('target, type, r')}) SELECT *, support::DOUBLE / (support + against) AS confidence FROM u WHERE support >= 20")
def _completeness_pairs(spark: SparkSession, d: str) -> DataFrame:
    meta = derived_schema(spark, d)
    return biases.completeness_pairs(derived_kb(spark, d), _truth(meta), meta, 20)


@register("seed_supports", _KB + _DONE + "SELECT 0 AS rule, (SELECT count(DISTINCT s) FROM kb WHERE r = 'returned' AND s IN (SELECT s FROM kb WHERE r = 'inNation' AND o = 'n3')) AS n UNION ALL SELECT 1, (SELECT count(DISTINCT a.s) FROM kb a JOIN kb b ON a.s = b.o AND a.o = b.s WHERE a.r = 'boughtFrom' AND b.r = 'soldTo' AND a.s IN (SELECT s FROM kb WHERE r = 'inNation' AND o = 'n3'))")
def _seed_supports(spark: SparkSession, d: str) -> DataFrame:
    kb = derived_kb(spark, d)
    seeds = kb.filter("r = 'inNation' and o = 'n3'").select(F.col("s").alias("e"))
    return _rows(spark, list(enumerate(biases.seed_supports(kb, seeds, [parse_rule("returned(?x,?y) => bought(?x,?y)"), parse_rule(TRAINED[1])]))), "rule int, n long")


@register("open_rules", f"""{_KB} st AS (SELECT r, count(*) AS n, count(DISTINCT s) >= count(DISTINCT o) AS f FROM kb GROUP BY r HAVING count(*) >= 1000), x AS (SELECT DISTINCT r, 's' AS side, s AS e FROM kb UNION ALL SELECT DISTINCT r, 'o', o FROM kb),
c AS (SELECT kb.r AS h, x.r AS b, x.side, count(*) AS facts, any_value(n) AS n, any_value(f) AS f FROM kb JOIN st ON st.r = kb.r JOIN x ON x.e = CASE WHEN f THEN kb.s ELSE kb.o END WHERE NOT (x.r = kb.r AND x.side = CASE WHEN f THEN 's' ELSE 'o' END) GROUP BY 1, 2, 3),
k AS (SELECT h, b, c.side, count(*) AS support FROM c JOIN x p ON p.r = b AND p.side = c.side JOIN x q ON q.e = p.e AND q.r = h AND q.side = CASE WHEN f THEN 's' ELSE 'o' END WHERE facts >= ceil(0.5 * n) GROUP BY 1, 2, 3), z AS (SELECT r, side, count(*) AS body_size FROM x GROUP BY 1, 2)
SELECT h AS head, b AS body, k.side, support, body_size FROM k JOIN z ON z.r = b AND z.side = k.side WHERE support >= 0.5 * body_size""")
def _open_rules(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of one existential atom, which isn't the head's own."""
    found = biases.open_rules(derived_kb(spark, d), miner.Config(max_atoms=2, min_head_size=1000, min_head_coverage=0.5, min_pca_confidence=0.5))
    rows = [(r.head.r, a.r, "s" if a.s == r.counted_variable else "o", int(r.support), r.body_size) for r in found for a in [r.body[-1]]]
    return _rows(spark, [x for x, r in zip(rows, found) if not (x[0] == x[1] and x[2] == ("s" if r.counted == 0 else "o"))], "head string, body string, side string, support long, body_size long")


@register("conditional_keys", _KB + " p AS (SELECT a.s, a.o AS k, b.o AS condition FROM kb a JOIN kb b ON a.s = b.s WHERE a.r = 'returned' AND b.r = 'inNation'), one AS (SELECT condition, k, min(s) AS s FROM p GROUP BY 1, 2 HAVING count(DISTINCT s) = 1), u AS (SELECT condition, count(DISTINCT s) AS support FROM one GROUP BY 1), v AS (SELECT condition, count(DISTINCT s) AS subjects FROM p GROUP BY 1) SELECT v.condition, subjects, support, support::DOUBLE / subjects AS confidence FROM v JOIN u USING (condition) WHERE support >= 10")
def _conditional_keys(spark: SparkSession, d: str) -> DataFrame:
    return biases.conditional_keys(derived_kb(spark, d), "returned", "inNation")


@register("key_pairs", _KB + """ p AS (SELECT a.s, a.o AS x, b.o AS y FROM kb a JOIN kb b ON a.s = b.s WHERE a.r = 'inNation' AND b.r = 'inSegment'), q AS (SELECT a.s, a.o AS x, b.o AS y FROM kb a JOIN kb b ON a.s = b.s WHERE a.r = 'inNation' AND b.r = 'returned'),
u AS (SELECT 'inNation+inSegment' AS key, (SELECT count(DISTINCT s) FROM (SELECT min(s) AS s FROM p GROUP BY x, y HAVING count(DISTINCT s) = 1)) AS support, (SELECT count(DISTINCT s) FROM p) AS subjects UNION ALL SELECT 'inNation+returned', (SELECT count(DISTINCT s) FROM (SELECT min(s) AS s FROM q GROUP BY x, y HAVING count(DISTINCT s) = 1)), (SELECT count(DISTINCT s) FROM q)) SELECT *, support::DOUBLE / subjects AS confidence FROM u""")
def _key_pairs(spark: SparkSession, d: str) -> DataFrame:
    return biases.keys(derived_kb(spark, d), ["inNation", "inSegment", "returned"]).filter("key in ('inNation+inSegment', 'inNation+returned')")


# --- inference and evaluation


@register("evaluation_verdicts", _KB + _OLD + """ p AS (SELECT s, r, CASE WHEN substr(md5(s), 1, 1) < '8' THEN o ELSE 'c0' END AS o FROM kb WHERE r = 'placedBy'), tr AS (SELECT DISTINCT s FROM old WHERE r = 'placedBy'), fo AS (SELECT count(DISTINCT s) >= 0.9 * count(*) AS f FROM old WHERE r = 'placedBy'), ft AS (SELECT count(DISTINCT s) >= 0.9 * count(*) AS f FROM kb WHERE r = 'placedBy')
SELECT p.s, p.r, p.o, CASE WHEN kb.s IS NOT NULL THEN 'True' WHEN tr.s IS NOT NULL OR ft.f THEN 'False' ELSE 'Unknown' END AS verdict, CASE WHEN kb.s IS NOT NULL THEN 'TargetSource' WHEN tr.s IS NOT NULL AND fo.f THEN 'TrainingSource' WHEN ft.f THEN 'TargetSource' ELSE 'Undefined' END AS source FROM p CROSS JOIN fo CROSS JOIN ft LEFT JOIN kb ON kb.s = p.s AND kb.r = p.r AND kb.o = p.o LEFT JOIN tr ON tr.s = p.s""")
def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Half of the orders placed by the wrong client: False by the training facts, by the target's, or True."""
    kb, old = derived_kb(spark, d), derived_kb(spark, d, SPLIT)
    facts = kb.filter("r = 'placedBy'").select("s", "r", F.when(F.substring(F.md5("s"), 1, 1) < "8", F.col("o")).otherwise("c0").alias("o"))
    return predict.evaluate(facts, old, kb, relations=["placedBy"])


def _judged(spark: SparkSession, d: str) -> list[DataFrame]:
    return predict.judged(derived_kb(spark, d, SPLIT), derived_kb(spark, d), [parse_rule(r) for r in TRAINED])


_JUDGED = _KB + _OLD + _RULES + " p AS (SELECT * FROM hits ANTI JOIN old USING (s, r, o)), v AS (SELECT p.*, CASE WHEN kb.s IS NULL THEN 'Unknown' ELSE 'True' END AS verdict FROM p LEFT JOIN kb USING (s, r, o)),"


@register("evaluation_files", _JUDGED + _DONE + "SELECT CASE verdict WHEN 'Unknown' THEN 'manual' ELSE 'automatic' END AS file, count(*) AS n FROM v GROUP BY 1")
def _files(spark: SparkSession, d: str) -> DataFrame:
    auto, manual = predict.split_evaluated(reduce(DataFrame.unionAll, _judged(spark, d)))
    return auto.groupBy().agg(F.lit("automatic").alias("file"), F.count("*").alias("n")).union(manual.groupBy().agg(F.lit("manual"), F.count("*"))).filter("n > 0")


@register("overridden_verdicts", _JUDGED + _DONE + "SELECT s, r, o, verdict AS before, CASE WHEN r = 'bought' THEN 'False' ELSE verdict END AS verdict FROM v")
def _overridden(spark: SparkSession, d: str) -> DataFrame:
    judged = reduce(DataFrame.unionAll, _judged(spark, d)).select("s", "r", "o", F.col("verdict").alias("before"), "verdict")
    return predict.override(judged, judged.filter("r = 'bought'").select("s", "r", "o", F.lit("False").alias("verdict")), ["bought"])


@register("merged_evaluations", _JUDGED + _DONE + "SELECT rule, count(*) AS n FROM v GROUP BY rule")
def _merged(spark: SparkSession, d: str) -> DataFrame:
    judged = reduce(DataFrame.unionAll, _judged(spark, d))
    return predict.merge_evaluations(judged.filter("rule = 0"), judged.filter("rule <> 0")).groupBy("rule").agg(F.count("*").alias("n"))


@register("rules_per_fact", _JUDGED + _DONE + "SELECT rules, verdict, count(*) AS n FROM (SELECT s, r, o, verdict, count(DISTINCT rule) AS rules FROM v GROUP BY 1, 2, 3, 4) GROUP BY 1, 2")
def _per_fact(spark: SparkSession, d: str) -> DataFrame:
    return predict.rules_per_fact(*_judged(spark, d))


_WEIGHTS = " w(rule, c) AS (VALUES (0, 0.3::DOUBLE), (1, 0.9::DOUBLE), (2, 0.8::DOUBLE)), j AS (SELECT s, r, o, 1 - product(1 - c) AS naive FROM hits JOIN w USING (rule) GROUP BY 1, 2, 3),"


def _joint(spark: SparkSession, d: str) -> DataFrame:
    return predict.joint_from_rules(derived_kb(spark, d, SPLIT), [parse_rule(r) for r in TRAINED], [0.3, 0.9, 0.8])


@register("top_predictions", _KB + _OLD + _RULES + _WEIGHTS + " k AS (SELECT s, r, o, round(naive, 9) AS naive FROM j) SELECT s, r, o, naive FROM k ORDER BY naive DESC, s, r, o LIMIT 50")
def _top_predictions(spark: SparkSession, d: str) -> DataFrame:
    return predict.top_predictions(_joint(spark, d).select("s", "r", "o", F.round("naive", 9).alias("naive")), "naive", 50)


@register("bucket_sample", _KB + _OLD + _RULES + _WEIGHTS + " b AS (SELECT s, r, o, greatest(0, 9 - floor(round(naive, 9) * 10)::INT) AS bucket FROM j) SELECT s, r, o, bucket FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY md5('' || chr(9) || s || chr(9) || r || chr(9) || o), s, r, o) <= 20")
def _buckets(spark: SparkSession, d: str) -> DataFrame:
    return predict.bucket_sample(_joint(spark, d).select("s", "r", "o", F.round("naive", 9).alias("score")), 20).select("s", "r", "o", "bucket")


@register("unlinked_predictions", _KB + _OLD + _RULES + " p AS (SELECT * FROM hits ANTI JOIN old USING (s, r, o)) SELECT rule, s, r, o FROM p WHERE (s, o) NOT IN (SELECT s, o FROM old WHERE r <> 'soldTo')")
def _unlinked(spark: SparkSession, d: str) -> DataFrame:
    found, old, _ = _trained(spark, d, False)
    return predict.unlinked(found, old, "soldTo")


ORACLES["joint_confidence"] = _KB + _OLD + """ a AS (SELECT DISTINCT b.s AS x, a.o AS y FROM old a JOIN old b ON b.o = a.s WHERE a.r = 'suppliedBy' AND b.r = 'bought'), b AS (SELECT o AS x, s AS y FROM old WHERE r = 'soldTo'), h AS (SELECT s AS x, o AS y FROM old WHERE r = 'boughtFrom'), f AS (SELECT true AS f),
c AS (SELECT * FROM a SEMI JOIN b USING (x, y)), m AS (SELECT '0' AS rules, * FROM a UNION ALL SELECT '1', * FROM b UNION ALL SELECT '0,1', * FROM c), k AS (SELECT DISTINCT s FROM old WHERE r = 'boughtFrom')
SELECT rules, round(count(*) FILTER ((x, y) IN (SELECT (x, y) FROM h))::DOUBLE / count(*) FILTER (x IN (SELECT s FROM k)), 9) AS confidence FROM m WHERE rules = '0,1' OR (rules = '0' AND EXISTS (SELECT 1 FROM a ANTI JOIN b USING (x, y))) OR (rules = '1' AND EXISTS (SELECT 1 FROM b ANTI JOIN a USING (x, y))) GROUP BY rules"""


_P = " p AS (SELECT *, 0.5 + ((ascii(md5(s || r || o)) + ascii(substr(md5(s || r || o), 2, 1))) % 50) / 100.0::DOUBLE AS p FROM kb),"


@register("probabilistic_pca", _KB + _P + """ b AS (SELECT o AS s, s AS o, p FROM p WHERE r = 'soldTo'), sm AS (SELECT s, 1 - exp(sum(ln(1 - p))) AS any_ FROM p WHERE r = 'boughtFrom' GROUP BY s)
SELECT 'soldTo(?y,?x) => boughtFrom(?x,?y)' AS rule, round((SELECT sum(h.p * b.p) FROM p h JOIN b ON h.s = b.s AND h.o = b.o WHERE h.r = 'boughtFrom'), 3) AS support, round((SELECT sum(b.p * any_) FROM b JOIN sm USING (s)), 3) AS pca_body""")
def _probabilistic_pca(spark: SparkSession, d: str) -> DataFrame:
    rows = biases.probabilistic_rules(derived_probabilistic(spark, d), [parse_rule("soldTo(?y,?x) => boughtFrom(?x,?y)")])
    return rows.select("rule", F.round("support", 3).alias("support"), F.round("pca_body", 3).alias("pca_body"))


