"""The registered queries over the derived knowledge base, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespark.operators import align, biases, metrics, miner, predict, schema, setops, stats
from rulespark.operators.storage import stored
from rulespark.plans import bgp
from rulespark.plans.terms import Atom, parse_rule
from rulespark.sources.derived import derived_kb, derived_other, derived_probabilistic, derived_schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPLIT = "1998-01-01"


def _kb_sql(orders: str = "orders", lines: str = "lineitem") -> str:
    sold = f"{orders} o JOIN {lines} l ON o.o_orderkey = l.l_orderkey"
    return f"""
  SELECT 'o' || o_orderkey AS s, 'placedBy' AS r, 'c' || o_custkey AS o FROM {orders}
  UNION SELECT 'o' || o_orderkey, 'hasStatus', 'st_' || o_orderstatus FROM {orders}
  UNION SELECT 'o' || o_orderkey, 'hasPriority', 'pr_' || o_orderpriority FROM {orders}
  UNION SELECT 'c' || c_custkey, 'inNation', 'n' || c_nationkey FROM customer
  UNION SELECT 's' || s_suppkey, 'inNation', 'n' || s_nationkey FROM supplier
  UNION SELECT 'c' || c_custkey, 'inSegment', 'sg_' || c_mktsegment FROM customer
  UNION SELECT 'n' || n_nationkey, 'inRegion', 'g' || n_regionkey FROM nation
  UNION SELECT 'p' || p_partkey, 'hasBrand', 'b_' || p_brand FROM part
  UNION SELECT 'o' || l_orderkey, 'hasPart', 'p' || l_partkey FROM {lines}
  UNION SELECT 'o' || l_orderkey, 'hasSupplier', 's' || l_suppkey FROM {lines}
  UNION SELECT 'p' || l_partkey, 'suppliedBy', 's' || l_suppkey FROM {lines}
  UNION SELECT 'c' || o.o_custkey, 'bought', 'p' || l.l_partkey FROM {sold}
  UNION SELECT 'c' || o.o_custkey, 'boughtFrom', 's' || l.l_suppkey FROM {sold}
  UNION SELECT 'c' || o.o_custkey, 'returned', 'p' || l.l_partkey FROM {sold} WHERE l.l_returnflag = 'R'
  UNION SELECT 's' || l.l_suppkey, 'soldTo', 'c' || o.o_custkey FROM {sold} WHERE o.o_orderstatus = 'F'
  UNION SELECT 'n' || a.n_nationkey, 'neighbour', 'n' || b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
  UNION SELECT 'c' || user_id, 'did', 'ev_' || event_type FROM events"""


_SCHEMA_SQL = """
  SELECT 'c' || c_custkey AS s, 'rdf:type' AS r, 'Customer' AS o FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'rdf:type', 'Supplier' FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'rdf:type', 'Part' FROM part
  UNION ALL SELECT 'o' || o_orderkey, 'rdf:type', 'Order' FROM orders
  UNION ALL SELECT 'n' || n_nationkey, 'rdf:type', 'Nation' FROM nation
  UNION ALL SELECT 'g' || r_regionkey, 'rdf:type', 'Region' FROM region
  UNION ALL VALUES ('Customer', 'rdfs:subClassOf', 'Party'), ('Supplier', 'rdfs:subClassOf', 'Party'), ('Party', 'rdfs:subClassOf', 'Thing'), ('Thing', 'rdfs:subClassOf', 'Party'),
    ('placedBy', 'rdfs:domain', 'Order'), ('placedBy', 'rdfs:range', 'Customer'), ('boughtFrom', 'rdfs:subPropertyOf', 'dealsWith'), ('dealsWith', 'rdfs:domain', 'Party')"""
_KB = f"WITH RECURSIVE kb AS MATERIALIZED ({_kb_sql()}),"
_OLD = f" oldorders AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT}'), oldlines AS (SELECT lineitem.* FROM lineitem SEMI JOIN oldorders ON l_orderkey = o_orderkey), old AS ({_kb_sql('oldorders', 'oldlines')}),"
_META = f" meta AS ({_SCHEMA_SQL}),"
_OTHER = " other AS (SELECT s, '<db:' || r || '>' AS r, o FROM kb WHERE substr(md5(s || r || o), 1, 1) NOT IN ('0', '1', '2')),"
_DEG = " ds AS (SELECT r, s AS e, count(*) AS deg FROM kb GROUP BY 1, 2), dn AS (SELECT r, o AS e, count(*) AS deg FROM kb GROUP BY 1, 2),"


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def _simple(name: str, of_kb: Callable[[DataFrame], DataFrame], sql: str | None = None, deg: bool = False) -> None:
    QUERIES[name] = lambda spark, d: of_kb(derived_kb(spark, d))
    if sql:
        ORACLES[name] = _KB + (_DEG if deg else "") + " done AS (SELECT 1) " + sql


# --- counts and statistics

_simple("kb_facts", lambda kb: kb, "SELECT s, r, o FROM kb")
_simple("kb_size", stats.kb_size, "SELECT count(*) AS facts, count(DISTINCT s) AS subjects, count(DISTINCT r) AS relations, count(DISTINCT o) AS objects, (SELECT count(*) FROM (SELECT s FROM kb UNION SELECT o FROM kb)) AS entities FROM kb")
_simple("kb_relation_sizes", stats.relation_sizes, "SELECT r, count(*) AS n FROM kb GROUP BY r")
_simple("kb_big_relations", lambda kb: stats.relation_sizes(kb, 10000), "SELECT r, count(*) AS n FROM kb GROUP BY r HAVING count(*) >= 10000")
_simple("kb_entities", stats.entities, "SELECT s AS e FROM kb UNION SELECT o FROM kb")
_simple("entity_occurrences", stats.occurrences, "SELECT e, count(*) AS n FROM (SELECT s AS e FROM kb UNION ALL SELECT o FROM kb) GROUP BY e")
_simple("functionality", stats.functionality, "SELECT r, count(DISTINCT s)::DOUBLE / count(*) AS functionality FROM kb GROUP BY r")
_simple("inverse_functionality", stats.inverse_functionality, "SELECT r, count(DISTINCT o)::DOUBLE / count(*) AS inverse_functionality FROM kb GROUP BY r")
_simple("functional_sides", stats.functional_sides, "SELECT r, count(DISTINCT s) >= count(DISTINCT o) AS functional FROM kb GROUP BY r")
_simple(
    "fanout_variance",
    lambda kb: stats.summary(kb).select("r", F.round("variance", 6).alias("variance"), F.round("inverse_variance", 6).alias("inverse_variance")),
    "SELECT r, round(a, 6) AS variance, round(b, 6) AS inverse_variance FROM (SELECT r, var_pop(deg) AS a FROM ds GROUP BY r) JOIN (SELECT r, var_pop(deg) AS b FROM dn GROUP BY r) USING (r)",
    deg=True,
)
_simple(
    "kb_summary",
    lambda kb: stats.summary(kb).drop("variance", "inverse_variance"),
    "SELECT r, count(*) AS size, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, count(DISTINCT s)::DOUBLE / count(*) AS functionality, count(DISTINCT o)::DOUBLE / count(*) AS inverse_functionality, max(mo) AS max_out, max(mi) AS max_in FROM kb JOIN (SELECT r, max(deg) AS mo FROM ds GROUP BY r) USING (r) JOIN (SELECT r, max(deg) AS mi FROM dn GROUP BY r) USING (r) GROUP BY r",
    deg=True,
)
for _a, _b in ("ss", "so", "oo"):
    _simple(
        f"overlap_{_a}{_b}",
        lambda kb, a=_a, b=_b: stats.overlaps(kb, a, b),
        f"SELECT a.r AS r1, b.r AS r2, count(*) AS n FROM (SELECT DISTINCT r, {_a} AS e FROM kb) a JOIN (SELECT DISTINCT r, {_b} AS e FROM kb) b USING (e) WHERE a.r <> b.r GROUP BY 1, 2",
    )
_simple("fanout_histogram", stats.fanout_histogram, "SELECT r, deg, count(*) AS n FROM ds GROUP BY 1, 2", deg=True)
_simple("inverse_fanout_histogram", lambda kb: stats.fanout_histogram(kb, "o"), "SELECT r, deg, count(*) AS n FROM dn GROUP BY 1, 2", deg=True)
_simple("cumulative_histogram", stats.cumulative_histogram, "SELECT r, unnest(range(0, deg)) AS above, count(*) AS n FROM ds GROUP BY 1, 2", deg=True)
_simple(
    "fanout_distribution",
    lambda kb: stats.fanout_distribution(kb).select("r", "deg", "n", "p", F.round("tail", 9).alias("tail")),
    "SELECT r, deg, n, n::DOUBLE / sum(n) OVER (PARTITION BY r) AS p, round(1 - (sum(n) OVER (PARTITION BY r ORDER BY deg))::DOUBLE / sum(n) OVER (PARTITION BY r), 9) AS tail FROM (SELECT r, deg, count(*) AS n FROM ds GROUP BY 1, 2)",
    deg=True,
)
_simple("maximal_cardinality", lambda kb: stats.maximal_cardinality(kb, limit=10), "SELECT r, coalesce(max(deg) FILTER (deg < 10), 10) AS n FROM ds GROUP BY r", deg=True)
_simple(
    "right_cumulative_cardinality",
    lambda kb: stats.right_cumulative_cardinality(kb, 20, 3),
    "cum AS (SELECT r, unnest(range(0, deg)) AS above, count(*) AS n FROM ds GROUP BY 1, 2) SELECT k.r, coalesce((SELECT min(c.above) FROM cum c, cum l WHERE c.r = k.r AND l.r = k.r AND l.above = 3 AND c.above > 3 AND c.n < l.n AND c.n >= 20), -1) AS n FROM (SELECT DISTINCT r FROM kb) k",
    deg=True,
)
_simple("hub_pairs", stats.hub_pairs, "SELECT r, sum(deg::DOUBLE * deg) AS pairs FROM dn GROUP BY r", deg=True)
ORACLES["right_cumulative_cardinality"] = ORACLES["right_cumulative_cardinality"].replace("done AS (SELECT 1) cum", "done AS (SELECT 1), cum")
_simple("contradictions", lambda kb: stats.contradictions(kb, ["inNation", "soldTo", "placedBy"]), "SELECT r, e, deg FROM ds WHERE r IN ('inNation', 'soldTo', 'placedBy') AND deg > 1", deg=True)
_simple("with_cardinality", lambda kb: stats.with_cardinality(kb, "returned", 10), "SELECT e FROM dn WHERE r = 'returned' AND deg = 10", deg=True)


# --- patterns and conjunctive queries


def _atoms(text: str) -> list[Atom]:
    return [Atom(*a.split()) for a in text.split(";")]


def _select(name: str, variables: str, atoms: str, sql: str) -> None:
    _simple(name, lambda kb: bgp.compile_query(kb, _atoms(atoms), variables.split()), sql)


_select("select_1var", "?x", "?x inNation n3", "SELECT DISTINCT s AS x FROM kb WHERE r = 'inNation' AND o = 'n3'")
_select("select_2var", "?x ?y", "?x returned ?y", "SELECT s AS x, o AS y FROM kb WHERE r = 'returned'")
_select("select_3var", "?x ?r ?y", "?x ?r ?y; ?y inRegion g1".replace("; ", ";"), "SELECT a.s AS x, a.r AS r, a.o AS y FROM kb a JOIN (SELECT DISTINCT s FROM kb WHERE r = 'inRegion' AND o = 'g1') b ON a.o = b.s")
_select("select_path", "?x ?z", "?x returned ?y;?y suppliedBy ?z", "SELECT DISTINCT a.s AS x, b.o AS z FROM kb a JOIN kb b ON a.o = b.s WHERE a.r = 'returned' AND b.r = 'suppliedBy'")
_select("relation_variable", "?r ?y", "c1 ?r ?x;?x ?q ?y".replace(";", ";"), "SELECT DISTINCT a.r AS r, b.o AS y FROM kb a JOIN kb b ON a.o = b.s WHERE a.s = 'c1'")
_select("different_from", "?x ?y", "?x inNation ?n;?y inNation ?n;?x soldTo ?y;?x differentFrom ?y", "SELECT DISTINCT c.s AS x, c.o AS y FROM kb c JOIN kb a ON a.s = c.s AND a.r = 'inNation' JOIN kb b ON b.s = c.o AND b.r = 'inNation' AND a.o = b.o WHERE c.r = 'soldTo' AND c.s <> c.o")
_select("equals_filter", "?x ?y", "?x neighbour ?z;?z neighbour ?y;?x equals ?y", "SELECT DISTINCT a.s AS x, b.o AS y FROM kb a JOIN kb b ON a.o = b.s WHERE a.r = 'neighbour' AND b.r = 'neighbour' AND a.s = b.o")
_select("exists_semi", "?x", "?x inNation n3;returned exists ?x", "SELECT DISTINCT s AS x FROM kb WHERE r = 'inNation' AND o = 'n3' AND s IN (SELECT s FROM kb WHERE r = 'returned')")
_select("exists_inverse", "?x", "?x hasBrand b_Brand#11;returned existsInv ?x", "SELECT DISTINCT s AS x FROM kb WHERE r = 'hasBrand' AND o = 'b_Brand#11' AND s IN (SELECT o FROM kb WHERE r = 'returned')")
_select("not_exists_anti", "?x", "?x inNation n3;returned ~exists ?x", "SELECT DISTINCT s AS x FROM kb WHERE r = 'inNation' AND o = 'n3' AND s NOT IN (SELECT s FROM kb WHERE r = 'returned')")
_select("not_exists_generate", "?x", "returned ~exists ?x", "SELECT DISTINCT s AS x FROM kb WHERE s NOT IN (SELECT s FROM kb WHERE r = 'returned')")
_select("not_exists_inverse_generate", "?x", "returned ~existsInv ?x", "SELECT DISTINCT o AS x FROM kb WHERE o NOT IN (SELECT o FROM kb WHERE r = 'returned')")
_select("not_exists_relation_variable", "?r ?x", "?r ~exists ?x;?x inRegion g1", "SELECT r, x FROM (SELECT DISTINCT r FROM kb), (SELECT s AS x FROM kb WHERE r = 'inRegion' AND o = 'g1') EXCEPT SELECT r, s FROM kb")
_select("cardinality_eq", "?x", "?x hasNumberOfValuesEquals3 hasPart", "SELECT s AS x FROM kb WHERE r = 'hasPart' GROUP BY s HAVING count(*) = 3")
_select("cardinality_eq_zero", "?x", "?x hasNumberOfValuesEquals0 hasPart", "SELECT DISTINCT s AS x FROM kb WHERE s NOT IN (SELECT s FROM kb WHERE r = 'hasPart')")
_select("cardinality_gt", "?x", "?x hasNumberOfValuesGreaterThan4 hasPart", "SELECT s AS x FROM kb WHERE r = 'hasPart' GROUP BY s HAVING count(*) > 4")
_select("cardinality_lt", "?x", "?x hasNumberOfValuesSmallerThan2 hasPart", "SELECT s AS x FROM kb GROUP BY s HAVING count(*) FILTER (r = 'hasPart') < 2")
_select("cardinality_inverse_gt", "?x", "?x hasNumberOfValuesGreaterThanInv20 returned", "SELECT o AS x FROM kb WHERE r = 'returned' GROUP BY o HAVING count(*) > 20")
_select("cardinality_inverse_lt", "?x", "?x hasNumberOfValuesSmallerThanInv2 returned", "SELECT o AS x FROM kb GROUP BY o HAVING count(*) FILTER (r = 'returned') < 2")
_simple("count_projection", lambda kb: bgp.count_projection(kb, Atom("?x", "bought", "?y"), _atoms("?x returned ?z;?z suppliedBy s1")), "SELECT count(*) AS n FROM kb h WHERE h.r = 'bought' AND EXISTS (SELECT 1 FROM kb a JOIN kb b ON a.o = b.s WHERE a.s = h.s AND a.r = 'returned' AND b.r = 'suppliedBy' AND b.o = 's1')")
_simple(
    "count_projection_bindings_relation",
    lambda kb: bgp.count_projection_bindings(kb, Atom("?x", "returned", "?y"), [Atom("?x", "?r", "?z")], "?r"),
    "SELECT q.r AS r, count(*) AS n FROM kb h JOIN (SELECT DISTINCT s, r FROM kb) q ON q.s = h.s WHERE h.r = 'returned' GROUP BY q.r",
)
_simple("count_bindings", lambda kb: bgp.count_bindings(kb, "?y", Atom("?x", "returned", "?y")), "SELECT o AS y, count(*) AS n FROM kb WHERE r = 'returned' GROUP BY o")
_simple("frequent_bindings", lambda kb: bgp.frequent_bindings(kb, "?z", "?x", _atoms("?x returned ?y;?y suppliedBy ?z")), "SELECT b.o AS z, count(DISTINCT a.s) AS n FROM kb a JOIN kb b ON a.o = b.s WHERE a.r = 'returned' AND b.r = 'suppliedBy' GROUP BY b.o")
_simple("frequent_relations", lambda kb: bgp.frequent_bindings(kb, "?r", "?s", [Atom("?s", "?r", "?o")]), "SELECT r, count(DISTINCT s) AS n FROM kb GROUP BY r")
_simple("count_distinct_pairs", lambda kb: bgp.compile_query(kb, _atoms("?x returned ?y;?y suppliedBy ?z"), ["?x", "?z"]).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM (SELECT DISTINCT a.s, b.o FROM kb a JOIN kb b ON a.o = b.s WHERE a.r = 'returned' AND b.r = 'suppliedBy')")
_simple("difference_pairs", lambda kb: bgp.difference(kb, ["?x", "?y"], _atoms("?x bought ?y"), _atoms("?x returned ?y")), "SELECT s AS x, o AS y FROM kb WHERE r = 'bought' EXCEPT SELECT s, o FROM kb WHERE r = 'returned'")
_simple("difference_1var", lambda kb: bgp.difference(kb, ["?x"], _atoms("?x bought ?y"), _atoms("?x returned ?z")), "SELECT s AS x FROM kb WHERE r = 'bought' EXCEPT SELECT s FROM kb WHERE r = 'returned'")
_simple("difference_no_common", lambda kb: bgp.difference_no_vars_in_common(kb, ["?x", "?y"], _atoms("?x inNation ?y"), Atom("?x", "returned", "?z")), "SELECT s AS x, o AS y FROM kb WHERE r = 'inNation' AND s NOT IN (SELECT s FROM kb WHERE r = 'returned')")
_simple(
    "difference_3var",
    lambda kb: bgp.difference(kb, ["?x", "?y", "?z"], _atoms("?x returned ?y;?y suppliedBy ?z"), _atoms("?x boughtFrom ?z")),
    "SELECT a.s AS x, a.o AS y, b.o AS z FROM (SELECT * FROM kb WHERE r = 'returned') a JOIN (SELECT * FROM kb WHERE r = 'suppliedBy') b ON a.o = b.s ANTI JOIN (SELECT s, o FROM kb WHERE r = 'boughtFrom') d ON d.s = a.s AND d.o = b.o",
)
_simple("adhoc_query", lambda kb: bgp.query(kb, "?a,?b", "soldTo(?a,?b) inNation(?a,?n) inNation(?b,?n)"), "SELECT DISTINCT a.s AS a, a.o AS b FROM kb a JOIN kb x ON x.s = a.s AND x.r = 'inNation' JOIN kb y ON y.s = a.o AND y.r = 'inNation' AND y.o = x.o WHERE a.r = 'soldTo'")


# --- rules

RULE = "suppliedBy(?z,?y) bought(?x,?z) => boughtFrom(?x,?y)"
_BODY = " body AS (SELECT DISTINCT b.s AS x, a.o AS y FROM kb a JOIN kb b ON b.o = a.s WHERE a.r = 'suppliedBy' AND b.r = 'bought'), head AS (SELECT s AS x, o AS y FROM kb WHERE r = 'boughtFrom'),"


@register(
    "rule_metrics",
    _KB
    + _BODY
    + f""" c AS (SELECT (SELECT count(*) FROM body) AS body_size, (SELECT count(*) FROM body JOIN head USING (x, y)) AS support, (SELECT count(*) FROM head) AS size,
  (SELECT count(DISTINCT x) FROM head) AS a, (SELECT count(DISTINCT y) FROM head) AS b, (SELECT count(*) FROM body WHERE x IN (SELECT x FROM head)) AS ps, (SELECT count(*) FROM body WHERE y IN (SELECT y FROM head)) AS po)
SELECT '{RULE}' AS rule, support::DOUBLE / size AS head_coverage, support::DOUBLE / body_size AS std_confidence, support::DOUBLE / CASE WHEN a >= b THEN ps ELSE po END AS pca_confidence,
  support, body_size, CASE WHEN a >= b THEN ps ELSE po END AS pca_body_size, CASE WHEN a >= b THEN '?x' ELSE '?y' END AS functional_variable FROM c""",
)
def _rule_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rule_metrics(derived_kb(spark, d), parse_rule(RULE), RULE)


_simple("rule_predictions", lambda kb: predict.predictions(kb, parse_rule(RULE)))
ORACLES["rule_predictions"] = _KB + _BODY + " done AS (SELECT 1) SELECT x AS s, 'boughtFrom' AS r, y AS o FROM body EXCEPT SELECT x, 'boughtFrom', y FROM head"
FALSE_RULE = "boughtFrom(?y,?x) => soldTo(?x,?y)"
_simple("pca_false_facts", lambda kb: predict.assumed_false(kb, parse_rule(FALSE_RULE)), "SELECT o AS s, 'soldTo' AS r, s AS o FROM kb WHERE r = 'boughtFrom' AND o IN (SELECT s FROM kb WHERE r = 'soldTo') EXCEPT SELECT s, r, o FROM kb")


def _pca_rule_row(kb: DataFrame) -> DataFrame:
    return metrics.rule_metrics(kb, parse_rule("boughtFrom(?y,?x) => soldTo(?x,?y)"), FALSE_RULE)


_simple("rule_pca_confidence", lambda kb: _pca_rule_row(kb).select("support", "body_size", "pca_body_size"))
ORACLES["rule_pca_confidence"] = _KB + """ side AS (SELECT count(DISTINCT s) >= count(DISTINCT o) AS f FROM kb WHERE r = 'soldTo'), body AS (SELECT o AS x, s AS y FROM kb WHERE r = 'boughtFrom')
SELECT (SELECT count(*) FROM body JOIN kb ON kb.s = x AND kb.o = y AND r = 'soldTo') AS support, (SELECT count(*) FROM body) AS body_size,
  (SELECT count(*) FROM body, side WHERE CASE WHEN f THEN x IN (SELECT s FROM kb WHERE r = 'soldTo') ELSE y IN (SELECT o FROM kb WHERE r = 'soldTo') END) AS pca_body_size"""

_TWO = f"""{_KB} st AS (SELECT r, count(*) AS n, count(DISTINCT s) >= count(DISTINCT o) AS f FROM kb GROUP BY r HAVING count(*) >= 100),
bodies AS (SELECT r AS b, s AS x, o AS y, false AS inv FROM kb UNION ALL SELECT r, o, s, true FROM kb),
sup AS (SELECT h.r AS h, b, inv, count(*) AS support FROM kb h JOIN bodies ON x = h.s AND y = h.o WHERE (b <> h.r OR inv) GROUP BY 1, 2, 3),
ok AS (SELECT sup.*, n, f FROM sup JOIN st ON st.r = sup.h WHERE support >= ceil(0.01 * n)),
ds AS (SELECT DISTINCT r, s AS e FROM kb), dn AS (SELECT DISTINCT r, o AS e FROM kb),
den AS (SELECT ok.h, ok.b, ok.inv, count(*) AS body_size, count(*) FILTER (CASE WHEN f THEN ds.e ELSE dn.e END IS NOT NULL) AS pca FROM ok JOIN bodies ON bodies.b = ok.b AND bodies.inv = ok.inv LEFT JOIN ds ON ds.r = ok.h AND ds.e = x LEFT JOIN dn ON dn.r = ok.h AND dn.e = y GROUP BY 1, 2, 3)
SELECT CASE WHEN inv THEN '?h1  ' || b || '  ?h0' ELSE '?h0  ' || b || '  ?h1' END || '   => ?h0  ' || h || '  ?h1' AS rule, support::DOUBLE / n AS head_coverage, support::DOUBLE / body_size AS std_confidence,
  support::DOUBLE / pca AS pca_confidence, support, body_size, pca AS pca_body_size, CASE WHEN f THEN '?a' ELSE '?b' END AS functional_variable FROM ok JOIN den USING (h, b, inv) WHERE support >= 0.1 * pca"""


@register("mine_2atom_rules", _TWO)
def _mine_two(spark: SparkSession, d: str) -> DataFrame:
    return miner.mine(derived_kb(spark, d), miner.Config(max_atoms=2))


@register("mine_closed_rules_skyline")
def _mine_three(spark: SparkSession, d: str) -> DataFrame:
    """Rules of three atoms over all relations, hubs included; its result is tested against a brute-force miner on small facts."""
    return miner.mine(derived_kb(spark, d), miner.Config(max_atoms=3))


_PATH = f"""{_KB} e AS (SELECT r, s AS a, o AS b, '+' AS d FROM kb UNION ALL SELECT r, o, s, '-' FROM kb),
k AS (SELECT * FROM e WHERE r IN ('bought', 'returned', 'suppliedBy', 'inNation', 'neighbour', 'soldTo'))
SELECT h.r AS head, p.r || p.d AS first, q.r || q.d AS second, count(DISTINCT (h.s, h.o)) AS support FROM kb h JOIN k p ON p.a = h.s JOIN k q ON q.a = p.b AND q.b = h.o WHERE h.r IN ('returned', 'neighbour') GROUP BY 1, 2, 3 HAVING count(DISTINCT (h.s, h.o)) >= 50"""


@register("mine_3atom_path_rules", _PATH)
def _path_supports(spark: SparkSession, d: str) -> DataFrame:
    """Supports of all path rules of three atoms over chosen relations, outward from the head: all of them in one job."""
    part = metrics.coded(derived_kb(spark, d).filter(F.col("r").isin("bought", "returned", "suppliedBy", "inNation", "neighbour", "soldTo")))
    found = metrics.triangle_counts(part, ["returned", "neighbour"]).filter("n >= 50")
    turned = F.concat(F.expr("left(ly, length(ly) - 1)"), F.when(F.col("ly").endswith("+"), "-").otherwise("+"))
    return found.select("head", F.col("lx").alias("first"), turned.alias("second"), F.col("n").alias("support"))


# --- predictions

TRAINED = ("suppliedBy(?z,?y) bought(?x,?z) => boughtFrom(?x,?y)", "soldTo(?y,?x) => boughtFrom(?x,?y)", "returned(?x,?y) => bought(?x,?y)")
_RULES = """ hits AS (SELECT DISTINCT 0 AS rule, b.s AS s, 'boughtFrom' AS r, a.o AS o FROM old a JOIN old b ON b.o = a.s WHERE a.r = 'suppliedBy' AND b.r = 'bought'
  UNION ALL SELECT 1, o, 'boughtFrom', s FROM old WHERE r = 'soldTo' UNION ALL SELECT 2, s, 'bought', o FROM old WHERE r = 'returned'),"""


def _trained(spark: SparkSession, d: str, known: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    old, new = derived_kb(spark, d, SPLIT), derived_kb(spark, d)
    return predict.all_predictions(old, [parse_rule(r) for r in TRAINED], known), old, new


@register("rule_hits", _KB + _OLD + _RULES + """ alone AS (SELECT s, r, o, count(*) AS rules FROM hits GROUP BY 1, 2, 3), m AS (SELECT hits.*, rules, ta.s IS NOT NULL AS ta, tr.s IS NOT NULL AS tr FROM hits JOIN alone USING (s, r, o) LEFT JOIN kb ta USING (s, r, o) LEFT JOIN old tr USING (s, r, o))
SELECT rule, count(*) AS n, count(*) FILTER (ta) AS in_target, count(*) FILTER (tr) AS in_training, count(*) FILTER (ta AND NOT tr) AS in_target_only, count(*) FILTER (ta AND rules = 1) AS in_target_unique, count(*) FILTER (ta AND NOT tr AND rules = 1) AS in_target_only_unique FROM m GROUP BY rule""")
def _hits(spark: SparkSession, d: str) -> DataFrame:
    found, old, new = _trained(spark, d, True)
    return predict.rule_hits(found, old, new)


@register("evaluation_summary", _KB + _OLD + _RULES + """ p AS (SELECT * FROM hits ANTI JOIN old USING (s, r, o)), v AS (SELECT p.*, kb.s IS NOT NULL AS hit FROM p LEFT JOIN kb USING (s, r, o))
SELECT rule, count(*) FILTER (hit) AS n_true, 0::BIGINT AS n_false, count(*) FILTER (NOT hit) AS n_unknown FROM v GROUP BY rule""")
def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    found = predict.judged(derived_kb(spark, d, SPLIT), derived_kb(spark, d), [parse_rule(r) for r in TRAINED])
    return predict.evaluation_summary(reduce(DataFrame.unionAll, found))


@register("naive_confidence", _KB + _OLD + _RULES + " w(rule, c) AS (VALUES (0, 0.3::DOUBLE), (1, 0.9::DOUBLE), (2, 0.8::DOUBLE)) SELECT s, r, o, string_agg(rule, ',' ORDER BY rule) AS rules, round(1 - product(1 - c), 9) AS naive FROM hits JOIN w USING (rule) GROUP BY 1, 2, 3")
def _naive(spark: SparkSession, d: str) -> DataFrame:
    found, _, _ = _trained(spark, d, True)
    weights = spark.createDataFrame([(0, 0.3), (1, 0.9), (2, 0.8)], "rule int, confidence double")
    return predict.joint_predictions(found, weights).withColumns({"naive": F.round("naive", 9), "rules": F.array_join(F.col("rules").cast("array<string>"), ",")})


@register("rule_body_report", _KB + _OLD + _RULES + " k AS (SELECT *, row_number() OVER (PARTITION BY s, r, o ORDER BY rule) AS k FROM hits) SELECT rule, count(*) AS n, count(*) FILTER (k = 1) AS n_new, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM k GROUP BY rule")
def _report(spark: SparkSession, d: str) -> DataFrame:
    return predict.rule_body_report(_trained(spark, d, True)[0])


@register("prediction_sample", _KB + _OLD + _RULES + " f AS (SELECT min(rule) AS rule, s, r, o FROM hits GROUP BY s, r, o) SELECT rule, s, r, o FROM f QUALIFY row_number() OVER (PARTITION BY rule ORDER BY md5('' || chr(9) || s || chr(9) || r || chr(9) || o), s, r, o) <= 25")
def _sample(spark: SparkSession, d: str) -> DataFrame:
    return predict.sample_by_rule(_trained(spark, d, True)[0], 25)


@register("cardinality_score", _KB + _OLD + " d AS (SELECT r, s, count(*) AS deg FROM old GROUP BY 1, 2), t AS (SELECT r, deg, count(*) AS n FROM d GROUP BY 1, 2), w AS (SELECT r, deg, (sum(n) OVER (PARTITION BY r) - sum(n) OVER (PARTITION BY r ORDER BY deg))::DOUBLE / (sum(n) OVER (PARTITION BY r))::DOUBLE AS score FROM t) SELECT kb.s, kb.r, kb.o, coalesce(score, 1) AS score FROM kb LEFT JOIN d ON d.r = kb.r AND d.s = kb.s LEFT JOIN w ON w.r = kb.r AND w.deg = d.deg WHERE kb.r = 'returned'")
def _cardinality_score(spark: SparkSession, d: str) -> DataFrame:
    return predict.cardinality_scores(derived_kb(spark, d, SPLIT), derived_kb(spark, d).filter("r = 'returned'"))


@register("probabilistic_support", _KB + """ p AS (SELECT *, 0.5 + ((ascii(md5(s || r || o)) + ascii(substr(md5(s || r || o), 2, 1))) % 50) / 100.0::DOUBLE AS p FROM kb), b AS (SELECT o AS s, s AS o, p FROM p WHERE r = 'soldTo')
SELECT round(sum(h.p * b.p), 4) AS support FROM p h JOIN b ON h.s = b.s AND h.o = b.o WHERE h.r = 'boughtFrom'""")
def _probabilistic(spark: SparkSession, d: str) -> DataFrame:
    return predict.probabilistic_support(derived_probabilistic(spark, d), parse_rule("soldTo(?y,?x) => boughtFrom(?x,?y)")).select(F.round("support", 4).alias("support"))


@register("rule_overlap", _KB + _BODY + " two AS (SELECT o AS x, s AS y FROM kb WHERE r = 'soldTo'), u AS (SELECT x, y FROM body UNION SELECT x, y FROM two), i AS (SELECT x, y FROM body INTERSECT SELECT x, y FROM two) SELECT (SELECT count(*) FROM i) AS both, (SELECT count(*) FROM u) AS either, (SELECT count(*) FROM i JOIN head USING (x, y)) AS both_known, (SELECT count(*) FROM u JOIN head USING (x, y)) AS either_known")
def _overlap(spark: SparkSession, d: str) -> DataFrame:
    return predict.rule_overlap(derived_kb(spark, d), parse_rule(TRAINED[0]), parse_rule(TRAINED[1]))


# --- sets, filters, schema


@register("kb_intersect", _KB + _OLD + " done AS (SELECT 1) SELECT s, r, o FROM kb INTERSECT SELECT s, r, o FROM old")
def _intersect(spark: SparkSession, d: str) -> DataFrame:
    return setops.intersect(derived_kb(spark, d), derived_kb(spark, d, SPLIT))


@register("kb_merge", _KB + _OTHER + " done AS (SELECT 1) SELECT s, r, o FROM kb UNION SELECT s, r, o FROM other")
def _merge(spark: SparkSession, d: str) -> DataFrame:
    return setops.merge(derived_kb(spark, d), derived_other(spark, d))


@register("kb_new_facts", _KB + _OLD + " done AS (SELECT 1) SELECT s, r, o FROM kb EXCEPT SELECT s, r, o FROM old")
def _new(spark: SparkSession, d: str) -> DataFrame:
    return setops.new_facts(derived_kb(spark, d, SPLIT), derived_kb(spark, d))


@register("kb_coalesce", _KB + _OLD + _OTHER + " k AS (SELECT DISTINCT s FROM other WHERE s IN (SELECT s FROM old UNION SELECT o FROM old)) SELECT s, r, o FROM old SEMI JOIN k USING (s) UNION SELECT s, r, o FROM other SEMI JOIN k USING (s)")
def _coalesce(spark: SparkSession, d: str) -> DataFrame:
    return setops.coalesce(derived_kb(spark, d, SPLIT), derived_other(spark, d))


_simple("entity_filter", lambda kb: setops.entity_filter(kb, kb.filter("r = 'inNation' and o = 'n3'").select(F.col("s").alias("e"))), "SELECT s, r, o FROM kb SEMI JOIN (SELECT s FROM kb WHERE r = 'inNation' AND o = 'n3') e USING (s)")
_simple("facts_filter", lambda kb: setops.facts_filter(kb, kb.filter("r = 'returned'"), with_objects=True), "SELECT s, r, o FROM kb WHERE s IN (SELECT s FROM kb WHERE r = 'returned' UNION SELECT o FROM kb WHERE r = 'returned')")
_simple("relation_filter", lambda kb: setops.drop_relations(kb, ["hasPart", "hasSupplier"]), "SELECT s, r, o FROM kb WHERE r NOT IN ('hasPart', 'hasSupplier')")
_simple("small_relation_filter", lambda kb: setops.drop_small_relations(kb, 10000), "SELECT s, r, o FROM kb WHERE r IN (SELECT r FROM kb GROUP BY r HAVING count(*) >= 10000)")
_simple("materialize_inverses", setops.materialise_inverses, "SELECT CASE WHEN t THEN o ELSE s END AS s, CASE WHEN t THEN 'inv-' || r ELSE r END AS r, CASE WHEN t THEN s ELSE o END AS o FROM kb JOIN (SELECT r, count(DISTINCT o) > count(DISTINCT s) AS t FROM kb GROUP BY r) USING (r)")
_simple("top_relevance", lambda kb: setops.top_entities(setops.relevance(kb), 100), "SELECT e, count(*)::DOUBLE AS relevance FROM (SELECT s AS e FROM kb UNION ALL SELECT o FROM kb) GROUP BY e ORDER BY 2 DESC, 1 LIMIT 100")
_simple("relevance_filter", lambda kb: setops.relevance_filter(kb, setops.top_entities(setops.relevance(kb), 100)), "top AS (SELECT e FROM (SELECT s AS e FROM kb UNION ALL SELECT o FROM kb) GROUP BY e ORDER BY count(*) DESC, e LIMIT 100), sides AS (SELECT r, count(DISTINCT s) >= count(DISTINCT o) AS f FROM kb GROUP BY r) SELECT s, kb.r, o FROM kb JOIN sides ON kb.r = sides.r WHERE CASE WHEN f THEN s ELSE o END IN (SELECT e FROM top)")
ORACLES["relevance_filter"] = ORACLES["relevance_filter"].replace("done AS (SELECT 1) top", "done AS (SELECT 1), top")
_simple("ingoing_links", lambda kb: setops.ingoing_links(kb, "placedBy"), """SELECT o AS s, '<hasIngoingLinks>' AS r, '"' || count(*) || '"^^xsd:integer' AS o FROM kb WHERE r = 'placedBy' GROUP BY kb.o""")
_simple("entity_sample", lambda kb: setops.entity_sample(kb, 20), "SELECT s, r, o FROM kb WHERE s IN (SELECT s FROM (SELECT DISTINCT r, s FROM kb) QUALIFY row_number() OVER (PARTITION BY r ORDER BY md5(s), s) <= 20)")


@register("kb_delta", _KB + _OLD + " a AS (SELECT r, s, list_sort(list(o)) AS x FROM old GROUP BY 1, 2), b AS (SELECT r, s, list_sort(list(o)) AS y FROM kb GROUP BY 1, 2) SELECT r, s, CASE WHEN x = y THEN 'No change' WHEN list_has_all(y, x) THEN 'Addition' WHEN list_has_all(x, y) THEN 'Deletion' ELSE 'Other' END AS change FROM a JOIN b USING (r, s)")
def _delta(spark: SparkSession, d: str) -> DataFrame:
    return setops.relation_changes(derived_kb(spark, d, SPLIT), derived_kb(spark, d))


_CLOSURE = " up(a, b) AS (SELECT s, o FROM meta WHERE r = 'rdfs:subClassOf' UNION SELECT up.a, m.o FROM up JOIN meta m ON m.s = up.b AND m.r = 'rdfs:subClassOf'),"


@register("subclass_closure", "WITH RECURSIVE" + _META + _CLOSURE + " done AS (SELECT 1) SELECT a, b FROM up")
def _closure(spark: SparkSession, d: str) -> DataFrame:
    return schema.subclass_closure(derived_schema(spark, d))


@register("type_closure", "WITH RECURSIVE" + _META + _CLOSURE + " own AS (SELECT s, o FROM meta WHERE r = 'rdf:type') SELECT DISTINCT own.s, 'rdf:type' AS r, up.b AS o FROM own JOIN up ON up.a = own.o EXCEPT SELECT s, 'rdf:type', o FROM own")
def _types(spark: SparkSession, d: str) -> DataFrame:
    return schema.new_type_facts(derived_schema(spark, d))


@register("type_sizes", "WITH RECURSIVE" + _META + " done AS (SELECT 1) SELECT o AS type, count(*) AS n FROM meta WHERE r = 'rdf:type' GROUP BY o")
def _type_sizes(spark: SparkSession, d: str) -> DataFrame:
    return stats.type_sizes(derived_schema(spark, d))


@register("signature_statistics", _KB + _META + " t AS (SELECT DISTINCT s AS e, o AS type FROM meta WHERE r = 'rdf:type'), a AS (SELECT r, type, count(*) AS n FROM (SELECT DISTINCT r, s AS e FROM kb) JOIN t USING (e) GROUP BY 1, 2), b AS (SELECT r, type, count(*) AS n FROM (SELECT DISTINCT r, o AS e FROM kb) JOIN t USING (e) GROUP BY 1, 2) SELECT r, type, coalesce(a.n, 0) AS on_domain, coalesce(b.n, 0) AS on_range, z.n AS type_size, k.n AS relation_size FROM a FULL JOIN b USING (r, type) JOIN (SELECT type, count(*) AS n FROM t GROUP BY 1) z USING (type) JOIN (SELECT r, count(*) AS n FROM kb GROUP BY 1) k USING (r)")
def _signature_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.signature_statistics(derived_kb(spark, d), derived_schema(spark, d).filter("r = 'rdf:type'"))


@register("domain_histogram", _KB + _META + " done AS (SELECT 1) SELECT deg, count(*) AS n FROM (SELECT m.s, count(kb.o) AS deg FROM (SELECT DISTINCT s FROM meta WHERE r = 'rdf:type' AND o = 'Customer') m LEFT JOIN kb ON kb.s = m.s AND kb.r = 'returned' GROUP BY m.s) GROUP BY deg")
def _domain_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.domain_histogram(derived_kb(spark, d), "returned", schema.entities_of_type(derived_schema(spark, d), "Customer"))


# --- further languages, alignment

_TYPES = " t AS (SELECT DISTINCT s AS e, o AS type FROM meta WHERE r = 'rdf:type'),"


@register("signature_rules", _KB + _META + _TYPES + " body AS (SELECT DISTINCT kb.r, t.type AS domain, kb.o AS e FROM kb JOIN t ON t.e = kb.s), h AS (SELECT r, domain, type AS range, count(*) AS support FROM body JOIN t USING (e) GROUP BY 1, 2, 3 HAVING count(*) >= 20), z AS (SELECT r, domain, count(*) AS body_size FROM body GROUP BY 1, 2) SELECT r, domain, range, support, body_size, support::DOUBLE / body_size AS std_confidence FROM h JOIN z USING (r, domain)")
def _signature_rules(spark: SparkSession, d: str) -> DataFrame:
    return biases.signature_rules(derived_kb(spark, d), derived_schema(spark, d), 20)


@register("existential_heads", _KB + _META + _TYPES + " z AS (SELECT type, count(*) AS body_size FROM t GROUP BY 1), g AS (SELECT z.*, k.r, (SELECT count(*) FROM (SELECT DISTINCT s FROM kb WHERE kb.r = k.r) q JOIN t ON t.e = q.s AND t.type = z.type) AS n FROM z, (SELECT DISTINCT r FROM kb) k), u AS (SELECT type, false AS negated, r, n AS support, body_size FROM g UNION ALL SELECT type, true, r, body_size - n, body_size FROM g) SELECT type, negated, r, support, body_size, support::DOUBLE / body_size AS std_confidence FROM u WHERE support >= 20")
def _existential_heads(spark: SparkSession, d: str) -> DataFrame:
    return biases.existential_heads(derived_kb(spark, d), derived_schema(spark, d), 20)


@register("link_rules", _KB + _META + _TYPES + " body AS (SELECT kb.s, kb.o, a.type AS domain, b.type AS range FROM kb JOIN t a ON a.e = kb.s JOIN t b ON b.e = kb.o WHERE kb.r = 'bought'), f AS (SELECT * FROM kb WHERE r <> 'bought'), sides AS (SELECT r, count(DISTINCT s) >= count(DISTINCT o) AS bs FROM f GROUP BY r), h AS (SELECT domain, range, f.r, count(*) AS support FROM body JOIN f ON f.s = body.s AND f.o = body.o GROUP BY 1, 2, 3 HAVING count(*) >= 1), x AS (SELECT h.domain, h.range, h.r, h.support, (SELECT count(*) FROM body b WHERE b.domain = h.domain AND b.range = h.range) AS body_size, (SELECT count(*) FROM body b WHERE b.domain = h.domain AND b.range = h.range AND CASE WHEN bs THEN b.s IN (SELECT s FROM f WHERE f.r = h.r) ELSE b.o IN (SELECT o FROM f WHERE f.r = h.r) END) AS pca_body_size FROM h JOIN sides ON sides.r = h.r) SELECT *, support::DOUBLE / pca_body_size AS pca_confidence FROM x")
def _link_rules(spark: SparkSession, d: str) -> DataFrame:
    return biases.link_rules(derived_kb(spark, d), derived_schema(spark, d), "bought", 1)


@register("key_mining", _KB + " done AS (SELECT 1)" + " UNION ALL ".join(f" SELECT '{r}' AS key, (SELECT count(DISTINCT x) FROM (SELECT min(s) AS x FROM kb WHERE r = '{r}' GROUP BY o HAVING count(*) = 1)) AS support, (SELECT count(DISTINCT s) FROM kb WHERE r = '{r}') AS subjects, (SELECT count(DISTINCT x) FROM (SELECT min(s) AS x FROM kb WHERE r = '{r}' GROUP BY o HAVING count(*) = 1))::DOUBLE / (SELECT count(DISTINCT s) FROM kb WHERE r = '{r}') AS confidence" for r in ("inSegment", "inNation", "returned", "placedBy")))
def _keys(spark: SparkSession, d: str) -> DataFrame:
    return biases.keys(derived_kb(spark, d), ["inSegment", "inNation", "returned", "placedBy"], most=1)


@register("align_equivalences", _KB + _OTHER + """ u AS (SELECT s, r, o, 0 AS k FROM kb UNION ALL SELECT s, r, o, 1 FROM other), b AS (SELECT r, s, o, k, false AS inv FROM u UNION ALL SELECT r, o, s, k, true FROM u),
h AS (SELECT b.r AS body, u.r AS head, inv, count(*) AS support FROM u JOIN b ON u.s = b.s AND u.o = b.o AND u.k <> b.k GROUP BY 1, 2, 3 HAVING count(*) >= 10), f AS (SELECT r, count(DISTINCT s) >= count(DISTINCT o) AS bs FROM u GROUP BY r), n AS (SELECT r, count(*) AS n FROM u GROUP BY r),
ds AS (SELECT DISTINCT r, s AS e FROM u), dn AS (SELECT DISTINCT r, o AS e FROM u),
p AS (SELECT h.body, h.head, h.inv, count(*) FILTER (CASE WHEN bs THEN ds.e ELSE dn.e END IS NOT NULL) AS pca FROM h JOIN f ON f.r = h.head JOIN b ON b.r = h.body AND b.inv = h.inv LEFT JOIN ds ON ds.r = h.head AND ds.e = b.s LEFT JOIN dn ON dn.r = h.head AND dn.e = b.o GROUP BY 1, 2, 3),
m AS (SELECT h.*, n.n AS size, support::DOUBLE / pca AS c FROM h JOIN p USING (body, head, inv) JOIN n ON n.r = h.body)
SELECT x.body AS r1, x.head AS r2, x.inv AS inverse, x.support AS intersection, x.size + y.size - x.support AS union, x.support::DOUBLE / (x.size + y.size - x.support) AS jaccard, least(x.c, y.c) AS confidence FROM m x JOIN m y ON x.body = y.head AND x.head = y.body AND x.inv = y.inv WHERE x.body < x.head""")
def _align(spark: SparkSession, d: str) -> DataFrame:
    kb = stored(derived_kb(spark, d), "facts")
    return align.equivalences(align.cross_rules(kb, derived_other(spark, d, kb)))
