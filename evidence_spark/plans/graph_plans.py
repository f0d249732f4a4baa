"""Queries over graphs and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import graph as G
from ..operators import rules as R
from .registry import Tables, query


def part_of(t: Tables) -> DataFrame:
    """order -> customer -> nation -> region and supplier -> nation, as edges(src, dst) of named nodes."""

    def edge(df: DataFrame, a: str, ca: str, b: str, cb: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(ca)).alias("src"), F.concat(F.lit(b), F.col(cb)).alias("dst"))

    return (edge(t.orders, "o", "o_orderkey", "c", "o_custkey").unionByName(edge(t.customer, "c", "c_custkey", "n", "c_nationkey"))
            .unionByName(edge(t.nation, "n", "n_nationkey", "r", "n_regionkey")).unionByName(edge(t.supplier, "s", "s_suppkey", "n", "s_nationkey")))


EDGES_SQL = """e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
REGIONS = "SELECT 'r' || r_regionkey AS seed FROM region"


def regions(t: Tables) -> DataFrame:
    name = F.concat(F.lit("r"), F.col("r_regionkey"))
    return t.region.select(name.alias("seed"), name.alias("node"))


def reverse(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@query("g1_reachable", f"""WITH RECURSIVE {EDGES_SQL}, w(seed, node) AS (SELECT seed, e.src FROM ({REGIONS}) JOIN e ON e.dst = seed UNION SELECT w.seed, e.src FROM w JOIN e ON e.dst = w.node) SELECT seed, node FROM w""")
def g1(t: Tables):
    return G.reachable(reverse(part_of(t)), regions(t))


@query("g2_hop_distance", f"""WITH RECURSIVE {EDGES_SQL}, w(seed, node, hops) AS (SELECT seed, seed, 0 FROM ({REGIONS}) UNION SELECT w.seed, e.src, hops + 1 FROM w JOIN e ON e.dst = w.node)
 SELECT seed, node, min(hops) AS hops FROM w GROUP BY ALL""")
def g2(t: Tables):
    return G.hop_distance(reverse(part_of(t)), regions(t))


def negatives(t: Tables) -> DataFrame:
    """A region negates the nations that have a poor supplier."""
    return t.supplier.filter("s_acctbal < 1000").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst")).distinct()


@query("g3_counters", f"""WITH RECURSIVE {EDGES_SQL}, neg AS (SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 1000),
 w(seed, node) AS (SELECT DISTINCT src, src FROM e WHERE src[1] = 'c' UNION SELECT w.seed, e.dst FROM w JOIN e ON e.src = w.node),
 goal(node) AS (SELECT 'r0' UNION SELECT e.src FROM goal JOIN e ON e.dst = goal.node)
 SELECT DISTINCT seed AS node, neg.dst AS counter FROM w JOIN neg ON neg.src = w.node WHERE neg.dst IN (SELECT node FROM goal)""")
def g3(t: Tables):
    customers = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))
    goals = t.region.filter("r_regionkey = 0").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    return G.counters(part_of(t), negatives(t), customers, goals)


BOUGHT_SQL = """i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), bw AS (SELECT x.p AS a, y.p AS b, count(*) AS n FROM i x JOIN i y ON x.o = y.o AND x.p < y.p GROUP BY ALL)"""


def bought_with(t: Tables) -> DataFrame:
    from ..operators.corpus import pairs_within

    return pairs_within(t.lineitem.select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("term")).distinct(), ["basket"]).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("g4_components", f"""WITH RECURSIVE {BOUGHT_SQL}, p AS (SELECT a, b FROM bw WHERE n >= 2), u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w(node, reach) AS (SELECT a, a FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.reach)
 SELECT node, min(reach) AS comp FROM w GROUP BY node""")
def g4(t: Tables):
    return G.components(bought_with(t).filter("n >= 2"))


# Graphs: one per nation; customers are instances, market segments concepts, the nation the goal; small accounts support nothing.
NATION_GRAPH_SQL = """gr AS (SELECT n_nationkey AS graph_id, 'g' || n_nationkey AS goal FROM nation),
 nd AS (SELECT c_nationkey AS graph_id, 'c' || c_custkey AS node, 'instance' AS layer, FALSE AS is_axiom, CASE WHEN c_acctbal > 1000 THEN c_name END AS source FROM customer
   UNION ALL SELECT DISTINCT c_nationkey, c_nationkey || c_mktsegment, 'concept', c_mktsegment = 'MACHINERY', NULL FROM customer UNION ALL SELECT n_nationkey, 'g' || n_nationkey, 'concept', FALSE, NULL FROM nation),
 ed AS (SELECT c_nationkey AS graph_id, 'c' || c_custkey AS src, c_nationkey || c_mktsegment AS dst FROM customer WHERE c_acctbal > 0 AND (c_mktsegment <> 'BUILDING' OR c_acctbal > 9000)
   UNION ALL SELECT DISTINCT c_nationkey, c_nationkey || c_mktsegment, 'g' || c_nationkey FROM customer WHERE c_mktsegment <> 'FURNITURE')"""


def nation_graphs(t: Tables):
    c = t.customer.withColumnRenamed("c_nationkey", "graph_id")
    seg = F.concat(F.col("graph_id").cast("string"), F.col("c_mktsegment"))
    goal = F.concat(F.lit("g"), F.col("graph_id"))
    cust = F.concat(F.lit("c"), F.col("c_custkey"))
    graphs = t.nation.select(F.col("n_nationkey").alias("graph_id")).withColumn("goal", goal)
    none = F.lit(None).cast("string")
    nodes = (c.select("graph_id", cust.alias("node"), F.lit("instance").alias("layer"), F.lit(False).alias("is_axiom"), F.when(F.col("c_acctbal") > 1000, F.col("c_name")).alias("source"))
             .unionByName(c.select("graph_id", seg.alias("node"), F.lit("concept").alias("layer"), (F.col("c_mktsegment") == "MACHINERY").alias("is_axiom"), none.alias("source")).distinct())
             .unionByName(graphs.select("graph_id", F.col("goal").alias("node"), F.lit("concept").alias("layer"), F.lit(False).alias("is_axiom"), none.alias("source"))))
    edges = (c.filter("c_acctbal > 0 AND (c_mktsegment <> 'BUILDING' OR c_acctbal > 9000)").select("graph_id", cust.alias("src"), seg.alias("dst"))
             .unionByName(c.filter("c_mktsegment <> 'FURNITURE'").select("graph_id", seg.alias("src"), goal.alias("dst")).distinct()))
    return graphs, nodes, edges


@query("g5_requirements", f"WITH {NATION_GRAPH_SQL} SELECT DISTINCT ed.graph_id, src AS req FROM ed JOIN gr ON ed.graph_id = gr.graph_id AND dst = goal")
def g5(t: Tables):
    graphs, _, edges = nation_graphs(t)
    return G.requirements(edges, graphs)


# By the theorem of Koenig and Hall the largest assignment leaves as many requirements empty as the worst set of them has
# more members than evidence; an order has few part types, so its sets can be listed.
@query("g6_assign_evidence", """WITH i AS (SELECT DISTINCT l_orderkey AS graph_id, l_suppkey AS ev, p_type AS req FROM lineitem JOIN part ON l_partkey = p_partkey),
 r AS (SELECT graph_id, req, req = 'PROMO' AS own FROM i GROUP BY ALL), k AS (SELECT graph_id, req, 1 << (row_number() OVER (PARTITION BY graph_id ORDER BY req) - 1) AS bit FROM r WHERE NOT own),
 n AS (SELECT graph_id, count(*) AS needed, count(*) FILTER (own) AS own FROM r GROUP BY graph_id),
 s AS (SELECT graph_id, unnest(range(1, 1 << (needed - own))) AS mask FROM n),
 c AS (SELECT s.graph_id, mask, count(DISTINCT k.req) - count(DISTINCT i.ev) AS lack FROM s JOIN k ON k.graph_id = s.graph_id AND s.mask & k.bit > 0 JOIN i ON i.graph_id = k.graph_id AND i.req = k.req GROUP BY ALL),
 d AS (SELECT graph_id, greatest(max(lack), 0) AS shortfall FROM c GROUP BY graph_id)
 SELECT graph_id, needed, needed - coalesce(shortfall, 0) AS filled, coalesce(shortfall, 0) AS shortfall FROM n LEFT JOIN d USING (graph_id)""")
def g6(t: Tables):
    """Per order: suppliers are evidence for the part types ordered; each supplier fills one; promoted types stand for
    themselves."""
    from ..operators.matching import assign_evidence

    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("graph_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("ev"), F.col("p_type").alias("req"))
    reqs = items.select("graph_id", "req").distinct()
    axioms = reqs.filter("req = 'PROMO'")
    filled = assign_evidence(items, reqs, axioms).groupBy("graph_id").agg(F.count("*").alias("filled"))
    need = reqs.groupBy("graph_id").agg(F.count("*").alias("needed"))
    return need.join(filled, "graph_id", "left").select("graph_id", "needed", F.coalesce("filled", F.lit(0)).alias("filled"), (F.col("needed") - F.coalesce("filled", F.lit(0))).alias("shortfall"))


DIAG_SQL = """rq AS (SELECT DISTINCT ed.graph_id, src AS req FROM {ed} ed JOIN gr ON ed.graph_id = gr.graph_id AND dst = goal),
 st(node) AS (SELECT node FROM nd WHERE layer = 'instance' OR is_axiom UNION SELECT ed.dst FROM st JOIN {ed} ed ON ed.src = st.node),
 sup AS (SELECT DISTINCT ed.dst AS node FROM st JOIN {ed} ed ON ed.src = st.node UNION SELECT node FROM nd WHERE is_axiom),
 dg AS (SELECT gr.graph_id, (SELECT count(*) FROM rq WHERE rq.graph_id = gr.graph_id) AS requirements, (SELECT count(*) FROM rq WHERE rq.graph_id = gr.graph_id AND req NOT IN (SELECT node FROM sup)) AS blocked,
  (SELECT count(*) FROM nd WHERE nd.graph_id = gr.graph_id AND layer = 'instance' AND node NOT IN (SELECT src FROM {ed})) AS orphans,
  (SELECT count(*) FROM nd WHERE nd.graph_id = gr.graph_id AND layer = 'concept' AND node NOT IN (SELECT node FROM sup)) AS unsupported,
  (SELECT count(*) FROM nd WHERE nd.graph_id = gr.graph_id AND is_axiom AND node NOT IN (SELECT src FROM {ed})) AS idle_axioms,
  (SELECT count(*) FROM nd WHERE nd.graph_id = gr.graph_id AND layer = 'instance' AND source IS NULL) AS missing_sources FROM gr)"""


@query("g7_diagnose", f"WITH RECURSIVE {NATION_GRAPH_SQL}, {DIAG_SQL.format(ed='ed')} SELECT * FROM dg")
def g7(t: Tables):
    graphs, nodes, edges = nation_graphs(t)
    return G.diagnose(graphs, nodes, edges, graphs)


@query("g12_structure_regression", f"""WITH RECURSIVE {NATION_GRAPH_SQL}, ed2 AS (SELECT * FROM ed UNION ALL SELECT graph_id, src, graph_id || 'BUILDING' FROM ed WHERE dst = graph_id || 'AUTOMOBILE'), {DIAG_SQL.format(ed='ed2')},
 sup1 AS (SELECT DISTINCT dst AS node FROM ed WHERE src IN (SELECT node FROM nd WHERE layer = 'instance' OR is_axiom) UNION SELECT node FROM nd WHERE is_axiom),
 rq1 AS (SELECT DISTINCT ed.graph_id, src AS req FROM ed JOIN gr ON ed.graph_id = gr.graph_id AND dst = goal),
 b1 AS (SELECT gr.graph_id, (SELECT count(*) FROM rq1 WHERE rq1.graph_id = gr.graph_id AND req NOT IN (SELECT node FROM sup1)) AS blocked FROM gr)
 SELECT dg.graph_id, CASE WHEN b1.blocked > 0 AND dg.blocked = 0 THEN 'fixed' WHEN b1.blocked = 0 AND dg.blocked > 0 THEN 'broken' ELSE 'same' END AS change FROM dg JOIN b1 USING (graph_id)""")
def g12(t: Tables):
    """Does every graph still stand if automobile evidence also supported the building concept?"""
    from ..operators.quality import regression_diff

    graphs, nodes, edges = nation_graphs(t)
    g = F.col("graph_id").cast("string")
    more = edges.unionByName(edges.filter(F.col("dst") == F.concat(g, F.lit("AUTOMOBILE"))).select("graph_id", "src", F.concat(g, F.lit("BUILDING")).alias("dst")))
    right = (F.col("blocked") == 0).alias("right")
    return regression_diff(G.diagnose(graphs, nodes, edges, graphs).select("graph_id", right), G.diagnose(graphs, nodes, more, graphs).select("graph_id", right), "graph_id")


@query("g8_shortest_path", """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(a, node, hops) AS (SELECT 's' || s_suppkey, 's' || s_suppkey, 0 FROM supplier UNION SELECT w.a, u.b, hops + 1 FROM w JOIN u ON u.a = w.node WHERE hops < 5)
 SELECT a, 'r' || r_regionkey AS b, min(hops) AS hops, count(DISTINCT hops) > 0 AS found FROM w JOIN region ON node = 'r' || r_regionkey GROUP BY ALL""")
def g8(t: Tables):
    def rel(df: DataFrame, a: str, ca: str, name: str, b: str, cb: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(ca)).alias("src"), F.lit(name).alias("rel"), F.concat(F.lit(b), F.col(cb)).alias("dst"))

    e = (rel(t.customer, "c", "c_custkey", "lives_in", "n", "c_nationkey").unionByName(rel(t.supplier, "s", "s_suppkey", "based_in", "n", "s_nationkey"))
         .unionByName(rel(t.nation, "n", "n_nationkey", "part_of", "r", "n_regionkey")).unionByName(rel(t.customer, "c", "c_custkey", "same_passage", "r", "c_nationkey")))
    asks = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("a")).join(F.broadcast(t.region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("b"))))
    found = G.shortest_path(e, asks, skip=["same_passage"])
    return found.select("a", "b", "hops", (F.size("path") == F.col("hops")).alias("found"))


@query("g9_chain_root", f"""WITH RECURSIVE {EDGES_SQL}, w(node, cur, depth) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT w.node, e.dst, depth + 1 FROM w JOIN e ON e.src = w.cur WHERE depth < 12)
 SELECT node, cur AS root, depth FROM w WHERE cur NOT IN (SELECT src FROM e)""")
def g9(t: Tables):
    return G.chain_root(part_of(t).select(F.col("src").alias("node"), F.col("dst").alias("parent")))


@query("g10_neighbor_boost", f"""WITH {BOUGHT_SQL}, u AS (SELECT a AS node, b AS nb FROM bw UNION SELECT b, a FROM bw), k AS (SELECT node, nb FROM u),
 s AS (SELECT k.node, p_size::DOUBLE AS sc, row_number() OVER (PARTITION BY k.node ORDER BY p_size DESC, nb) AS r FROM k JOIN part ON p_partkey = nb), t AS (SELECT node, sum(sc) AS s FROM s WHERE r <= 3 GROUP BY node)
 SELECT p_partkey AS node, p_size::DOUBLE + 0.25::DOUBLE * (coalesce(s, 0.0) / 3) AS boosted FROM part LEFT JOIN t ON node = p_partkey""")
def g10(t: Tables):
    scores = t.part.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("score"))
    return G.neighbor_boost(scores, bought_with(t).select(F.col("a").alias("src"), F.col("b").alias("dst")), 0.25)


@query("g11_causal_chain", f"""WITH RECURSIVE {EDGES_SQL}, cause AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal > 5000 UNION SELECT 'r' || r_regionkey FROM region),
 w(seed, node, hops) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey, 0 FROM orders UNION ALL SELECT w.seed, e.dst, hops + 1 FROM w JOIN e ON e.src = w.node), h AS (SELECT w.* FROM w JOIN cause USING (node) WHERE hops > 0),
 m AS (SELECT seed, min(hops) AS hops FROM h GROUP BY seed) SELECT h.seed, h.node, h.hops FROM h JOIN m USING (seed, hops)""")
def g11(t: Tables):
    orders = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("node"))
    causes = t.customer.filter("c_acctbal > 5000").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node")).unionByName(t.region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node")))
    return G.causal_chain(part_of(t), orders, causes)


# Steps of an order: each line needs the lines with a smaller part number and an earlier ship date; some need a missing step.
@query("l3_topological_order", """WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS plan, l_linenumber AS step, l_partkey AS p, l_shipdate AS d FROM lineitem),
 n AS (SELECT DISTINCT a.plan, a.step, b.step AS needs FROM s a JOIN s b ON a.plan = b.plan AND ((b.p < a.p AND b.d < a.d) OR (b.p > a.p + 1900 AND b.d < a.d)) AND a.step <> b.step
   UNION SELECT plan, step, 99 FROM s WHERE p < 20),
 bad AS (SELECT DISTINCT n.plan FROM n LEFT JOIN s ON s.plan = n.plan AND s.step = n.needs WHERE s.step IS NULL),
 w(plan, step, level) AS (SELECT DISTINCT s.plan, s.step, 0 FROM s UNION SELECT n.plan, n.step, level + 1 FROM w JOIN n ON n.plan = w.plan AND n.needs = w.step WHERE level < 20)
 SELECT plan, step, max(level) AS level FROM w WHERE plan NOT IN (SELECT plan FROM bad) AND plan NOT IN (SELECT plan FROM w WHERE level >= 20) GROUP BY ALL""")
def l3(t: Tables):
    s = t.lineitem.select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("p"), F.col("l_shipdate").alias("d")).distinct()
    o = s.select("plan", F.col("step").alias("needs"), F.col("p").alias("p2"), F.col("d").alias("d2"))
    need = s.join(o, "plan").filter("d2 < d AND step <> needs AND (p2 < p OR p2 > p + 1900)").select("plan", "step", "needs")
    need = need.unionByName(s.filter("p < 20").select("plan", "step", F.lit(99).alias("needs")))
    return G.topological_levels(s.select("plan", "step"), need)


# --- rules ---

PART_OF = R.Rule("part_of_transitive", (("?a", "part_of", "?b"), ("?b", "part_of", "?c")), ("?a", "part_of", "?c"))


def part_facts(t: Tables) -> DataFrame:
    return part_of(t).select(F.lit(0).alias("ctx"), F.col("src").alias("s"), F.lit("part_of").alias("p"), F.col("dst").alias("o"))


def denied_facts(t: Tables) -> DataFrame:
    """Customers in debt are denied membership of their nation."""
    return t.customer.filter("c_acctbal < 0").select(
        F.lit(0).alias("ctx"), F.concat(F.lit("c"), F.col("c_custkey")).alias("s"), F.lit("part_of").alias("p"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("o"))


CLOSURE_SQL = f"""{EDGES_SQL}, den AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer WHERE c_acctbal < 0), f AS (SELECT src, dst FROM e EXCEPT SELECT src, dst FROM den),
 w(s, o) AS (SELECT src, dst FROM f UNION SELECT w.s, f.dst FROM w JOIN f ON f.src = w.o WHERE (w.s, f.dst) NOT IN (SELECT (src, dst) FROM den))"""


@query("r1_closure", f"WITH RECURSIVE {CLOSURE_SQL} SELECT s, 'part_of' AS p, o FROM w")
def r1(t: Tables):
    return R.closure(part_facts(t), [PART_OF], denied_facts(t)).select("s", "p", "o")


@query("r2_first_proofs", f"""WITH {EDGES_SQL}, den AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS o FROM customer WHERE c_acctbal < 0), f AS (SELECT src AS s, dst AS o FROM e EXCEPT SELECT s, o FROM den),
 k0 AS (SELECT s, o, 0 AS round, NULL::VARCHAR AS rule, '' AS parents, sha256(concat_ws(chr(31), s, 'part_of', o)) AS id FROM f),
 n1 AS (SELECT a.s, b.o, min(a.id || ',' || b.id) AS parents FROM k0 a JOIN k0 b ON a.o = b.s GROUP BY a.s, b.o),
 k1 AS (SELECT * FROM k0 UNION ALL SELECT s, o, 1, 'part_of_transitive', parents, sha256(concat_ws(chr(31), s, 'part_of', o)) FROM n1 ANTI JOIN den USING (s, o) ANTI JOIN k0 USING (s, o)),
 n2 AS (SELECT a.s, b.o, min(a.id || ',' || b.id) AS parents FROM k1 a JOIN k1 b ON a.o = b.s WHERE a.round = 1 OR b.round = 1 GROUP BY a.s, b.o),
 k2 AS (SELECT * FROM k1 UNION ALL SELECT s, o, 2, 'part_of_transitive', parents, '' FROM n2 ANTI JOIN den USING (s, o) ANTI JOIN k1 USING (s, o))
 SELECT s, 'part_of' AS p, o, round, rule, parents FROM k2""")
def r2(t: Tables):
    d = R.closure(part_facts(t), [PART_OF], denied_facts(t), proofs=True)
    return d.select("s", "p", "o", "round", "rule", F.array_join("parents", ",").alias("parents"))


@query("r3_proof", f"""WITH RECURSIVE {CLOSURE_SQL}, tg AS (SELECT s, o FROM w WHERE s[1] = 'o' AND o[1] = 'r') SELECT s, o, 5 AS facts, 2 AS depth FROM tg""")
def r3(t: Tables):
    """Every order's region: two rules over three asserted premises."""
    d = R.closure(part_facts(t), [PART_OF], denied_facts(t), proofs=True)
    targets = d.filter("s LIKE 'o%' AND o LIKE 'r%'")
    return R.proof_sizes(d, targets).select("s", "o", F.col("facts").cast("int").alias("facts"), "depth")


def supplier_facts(t: Tables) -> DataFrame:
    """Per nation: suppliers supply parts, parts are of a type; ids are the facts themselves."""
    n = t.lineitem.select("l_suppkey", "l_partkey").distinct().join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    supplies = n.select(F.col("s_nationkey").alias("ctx"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("s"), F.lit("supplies").alias("p"), F.concat(F.lit("p"), F.col("p_partkey")).alias("o")).distinct()
    kind = n.select(F.col("s_nationkey").alias("ctx"), F.concat(F.lit("p"), F.col("p_partkey")).alias("s"), F.lit("is_a").alias("p"), F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand")).alias("o")).distinct()
    return supplies.unionByName(kind).withColumn("fid", F.concat_ws("|", "s", "p", "o"))


OFFERS = R.Rule("offers_kind", (("?s", "supplies", "?p"), ("?p", "is_a", "?k")), ("?s", "offers", "?k"))


@query("r4_closure_bundles", """WITH f AS (SELECT s_nationkey AS ctx, s_suppkey, p_partkey, p_type || '/' || p_brand AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
 SELECT ctx, 's' || s_suppkey AS s, k AS o, count(*) AS bundles, TRUE AS complete FROM f GROUP BY ALL""")
def r4(t: Tables):
    bundles, complete = R.closure_bundles(supplier_facts(t), [OFFERS])
    return bundles.filter("p = 'offers'").groupBy("ctx", "s", "o").agg(F.count("*").alias("bundles")).join(complete, "ctx").select("ctx", "s", "o", "bundles", "complete")


@query("r5_retract", """WITH f AS (SELECT s_nationkey AS ctx, s_suppkey, p_partkey, p_type || '/' || p_brand AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY ALL)
 SELECT ctx, 's' || s_suppkey AS s, k AS o, count(*) AS bundles FROM f GROUP BY ALL""")
def r5(t: Tables):
    """Withdraw what is known about the kind of small parts."""
    bundles, _ = R.closure_bundles(supplier_facts(t), [OFFERS])
    gone = t.part.filter("p_size <= 25").select(F.concat_ws("|", F.concat(F.lit("p"), F.col("p_partkey")), F.lit("is_a"), F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand"))).alias("fid"))
    return R.retract(bundles.filter("p = 'offers'"), gone).select("ctx", "s", "o", "bundles")


@query("r6_induce_rule", """SELECT 'order' AS shape, count(DISTINCT o_orderkey) AS examples, '?v1 placed_by ?v2 ?v2 lives_in ?v3 => ?v1 => ships_to => ?v3' AS rule, CAST(NULL AS VARCHAR) AS reason FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT 'loose', count(DISTINCT o_orderkey), '?v1 placed_by ?v2 => ?v1 => ships_to => ?v3', 'unbound' FROM orders JOIN customer ON o_custkey = c_custkey""")
def r6(t: Tables):
    """Every order is a worked example: placed by a customer who lives in a nation, so it ships to that nation."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    o, c, n = (F.concat(F.lit(p), F.col(k)) for p, k in (("o", "o_orderkey"), ("c", "o_custkey"), ("n", "c_nationkey")))

    def atom(pos: int, *terms):
        return [F.struct(F.lit(pos).alias("pos"), F.lit(i).alias("idx"), x.alias("value")) for i, x in enumerate(terms)]

    first, second, head = atom(0, o, F.lit("placed_by"), c), atom(1, c, F.lit("lives_in"), n), atom(-1, o, F.lit("ships_to"), n)
    rows = j.select(F.col("o_orderkey").alias("example"), F.explode(F.array(
        F.struct(F.lit("order").alias("shape"), F.array(*first, *second, *head).alias("x")), F.struct(F.lit("loose").alias("shape"), F.array(*first, *head).alias("x")))).alias("s"))
    ex = rows.select("example", "s.shape", F.explode("s.x").alias("x")).select("shape", "example", "x.pos", "x.idx", "x.value")
    out = R.induce_rule(ex)
    # Heads are listed first in the packed order; show the body first.
    head_part = F.regexp_extract("rule", r"^((?:=> \S+ ?){3})", 1)
    return out.select("shape", "examples", F.concat(F.trim(F.regexp_replace("rule", r"^(?:=> \S+ ?){3}", "")), F.lit(" "), F.trim(head_part)).alias("rule"), "reason")


SHIPS = R.Rule("ships_to", (("?o", "placed_by", "?c"), ("?c", "lives_in", "?n")), ("?o", "ships_to", "?n"))


@query("r7_gate_rule", """SELECT count(*) AS fixed, 0::BIGINT AS broken, 0::BIGINT AS wrong_corrections, 0::BIGINT AS wrong_validation, TRUE AS accepted FROM orders JOIN customer ON o_custkey = c_custkey""")
def r7(t: Tables):
    """Each order is a case of its own; half a year's orders correct, the rest validate (also that nothing else follows)."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    ctx, o, c, n = F.col("o_orderkey").alias("ctx"), *(F.concat(F.lit(p), F.col(k)) for p, k in (("o", "o_orderkey"), ("c", "o_custkey"), ("n", "c_nationkey")))
    facts = j.select(ctx, F.explode(F.array(
        F.struct(o.alias("s"), F.lit("placed_by").alias("p"), c.alias("o")), F.struct(c.alias("s"), F.lit("lives_in").alias("p"), n.alias("o")))).alias("f")).select("ctx", "f.s", "f.p", "f.o")
    early = F.col("o_orderstatus") == "F"
    yes = j.select(ctx, o.alias("s"), F.lit("ships_to").alias("p"), n.alias("o"), F.lit(True).alias("expected"), early.alias("is_correction"))
    no = j.select(ctx, c.alias("s"), F.lit("ships_to").alias("p"), n.alias("o"), F.lit(False).alias("expected"), F.lit(False).alias("is_correction"))
    return R.gate_rule([], SHIPS, facts, yes.unionByName(no))


@query("r8_inherited_actions", f"""WITH RECURSIVE {EDGES_SQL}, w(s, o) AS (SELECT src, dst FROM e UNION SELECT w.s, e.dst FROM w JOIN e ON e.src = w.o),
 acts AS (SELECT 'r' || r_regionkey AS cls, 'trades_' || r_name AS act FROM region UNION SELECT 'n' || n_nationkey, 'ships_' || n_name FROM nation)
 SELECT w.s, act AS o FROM w JOIN acts ON cls = w.o WHERE w.s[1] = 'o'""")
def r8(t: Tables):
    """An order is a member of its customer's classes and inherits what all members of a class do."""
    e = part_of(t)
    isa = e.filter("src LIKE 'o%'").select(F.lit(0).alias("ctx"), F.col("src").alias("s"), F.lit("isa").alias("p"), F.col("dst").alias("o"))
    sub = e.filter("src NOT LIKE 'o%'").select(F.lit(0).alias("ctx"), F.col("src").alias("s"), F.lit("subclass").alias("p"), F.col("dst").alias("o"))
    acts = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("s"), F.concat(F.lit("trades_"), F.col("r_name")).alias("o")).unionByName(
        t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("s"), F.concat(F.lit("ships_"), F.col("n_name")).alias("o"))).select(F.lit(0).alias("ctx"), "s", F.lit("all_action").alias("p"), "o")
    rules = [R.Rule("member_of_super", (("?x", "isa", "?c"), ("?c", "subclass", "?d")), ("?x", "isa", "?d")),
             R.Rule("inherits_action", (("?x", "isa", "?c"), ("?c", "all_action", "?v")), ("?x", "action", "?v"))]
    return R.closure(isa.unionByName(sub).unionByName(acts), rules).filter("p = 'action'").select("s", "o")


@query("r9_order_comparison", """WITH RECURSIVE v AS (SELECT p_partkey AS k, p_retailprice AS r, row_number() OVER (PARTITION BY p_brand, p_type, p_size // 10 ORDER BY p_retailprice DESC, p_partkey) AS rn, p_brand || p_type || (p_size // 10) AS p_brand FROM part),
 e AS (SELECT a.k AS hi, b.k AS lo FROM v a JOIN v b ON a.p_brand = b.p_brand AND b.rn = a.rn + 1), x AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)
   UNION SELECT a.k, b.k FROM v a JOIN v b ON a.p_brand = b.p_brand AND b.rn = a.rn + 3), d AS (SELECT hi, lo FROM e WHERE hi < lo)
 SELECT a, b, CASE WHEN (a, b) IN (SELECT (hi, lo) FROM d) THEN NULL WHEN va.p_brand = vb.p_brand THEN va.rn < vb.rn END AS taller FROM x JOIN v va ON va.k = a JOIN v vb ON vb.k = b""")
def r9(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    family = F.concat("p_brand", "p_type", F.floor(F.col("p_size") / 10))
    v = t.part.select(family.alias("p_brand"), "p_partkey", "p_retailprice").select("p_brand", F.col("p_partkey").alias("k"), F.row_number().over(w).alias("rn"))
    n = v.select("p_brand", F.col("k").alias("k2"), F.col("rn").alias("rn2"))
    e = v.join(n, "p_brand").filter("rn2 = rn + 1").select(F.col("k").alias("hi"), F.col("k2").alias("lo"))
    nxt = t.part.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b")).join(t.part.select(F.col("p_partkey").alias("a")), "a")
    asks = nxt.select("a", "b").unionByName(v.join(n, "p_brand").filter("rn2 = rn + 3").select(F.col("k").alias("a"), F.col("k2").alias("b"))).distinct()
    return R.order_comparison(e, e.filter("hi < lo"), asks)


@query("j8_rule_body_join", """SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p, 'n' || s_nationkey AS n, 'c' || o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey""")
def j8(t: Tables):
    """Suppliers of a part bought by a customer of their own nation."""
    li = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def fact(df, a, ca, p, b, cb):
        return df.select(F.lit(0).alias("ctx"), F.concat(F.lit(a), F.col(ca)).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(b), F.col(cb)).alias("o")).distinct()

    line = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    li = li.withColumn("line", line)
    facts = [fact(li, "l", "line", "item", "p", "l_partkey"), fact(li, "l", "line", "from", "s", "l_suppkey"), fact(li, "l", "line", "to", "c", "o_custkey"),
             fact(t.supplier, "s", "s_suppkey", "in", "n", "s_nationkey"), fact(t.customer, "c", "c_custkey", "in", "n", "c_nationkey")]
    base = facts[0]
    for f in facts[1:]:
        base = base.unionByName(f)
    body = [("?l", "item", "?p"), ("?l", "from", "?s"), ("?l", "to", "?c"), ("?s", "in", "?n"), ("?c", "in", "?n")]
    return R.rule_body_join([(a, base) for a in body]).select(*[F.col(f"?{x}").alias(x) for x in "spnc"]).distinct()


# --- graph tables: validation, includes, overlays ---


@query("f7_validate_graph", """WITH nodes AS (SELECT c_nationkey AS g, 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0), ed AS (SELECT c_nationkey AS g, 'c' || o_custkey AS src, o_orderstatus AS rel, 'c' || CAST(o_orderkey // 10 AS VARCHAR) AS dst FROM orders JOIN customer ON c_custkey = o_custkey)
 SELECT g AS graph_id, 'undefined_node' AS code, id AS detail FROM (SELECT g, src AS id FROM ed UNION SELECT g, dst FROM ed) x WHERE (g, id) NOT IN (SELECT (g, id) FROM nodes)
 UNION ALL SELECT DISTINCT g, 'unknown_relation', rel FROM ed WHERE rel NOT IN ('O', 'F') UNION ALL SELECT DISTINCT g, 'self_loop', src FROM ed WHERE src = dst
 UNION ALL SELECT n_nationkey, 'missing_key', 'goal' FROM nation WHERE n_regionkey = 3
 UNION ALL SELECT n_nationkey, 'goal_not_concept', 'c' || n_nationkey FROM nation WHERE n_regionkey <> 3
 UNION ALL SELECT g, 'no_alias', id FROM nodes JOIN customer ON 'c' || c_custkey = id WHERE c_mktsegment = 'BUILDING'
 UNION ALL SELECT n_nationkey, 'overlapping_roles', 'F' FROM nation WHERE n_regionkey = 1""")
def f7(t: Tables):
    """Customers with money are nodes; orders are edges between customers of a nation's graph."""
    key = F.concat(F.lit("c"), F.col("c_custkey"))
    rich = t.customer.filter("c_acctbal > 0")
    node = rich.select(F.col("c_nationkey").alias("graph_id"), key.alias("node_id"), F.lit("instance").alias("layer"), F.lit(False).alias("is_axiom"), F.lit(None).cast("string").alias("source_of"))
    alias = rich.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_nationkey").alias("graph_id"), key.alias("node_id"))
    edge = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("graph_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.col("o_orderstatus").alias("rel"), F.concat(F.lit("c"), F.floor(F.col("o_orderkey") / 10)).alias("dst"))
    graph = t.nation.select(
        F.col("n_nationkey").alias("graph_id"), F.when(F.col("n_regionkey") != 3, F.concat(F.lit("c"), F.col("n_nationkey"))).alias("goal"), F.array(F.lit("O"), F.lit("F")).alias("forward_rels"),
        F.when(F.col("n_regionkey") == 1, F.array(F.lit("F"))).otherwise(F.array().cast("array<string>")).alias("negative_rels"), F.array().cast("array<string>").alias("grounds_rels"))
    return FL.validate_graph(graph, node, alias, edge)


@query("j17_include_graphs", """SELECT (n_nationkey + 1) % 25 AS graph_id, 'c' || c_custkey AS src, CASE WHEN c_acctbal > 0 THEN 'f' || CAST((n_nationkey + 1) % 25 AS VARCHAR) ELSE 'x' || CAST((n_nationkey + 1) % 25 AS VARCHAR) END AS rel, c_mktsegment AS dst
 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'HOUSEHOLD'""")
def j17(t: Tables):
    """Each nation's graph borrows the edges of the nation before it; relation names change by role, others are dropped."""
    from ..operators.tables import include_edges

    g = F.col("n_nationkey")
    graphs = t.nation.select(g.alias("graph_id"), F.array(F.concat(F.lit("f"), g)).alias("forward_rels"), F.array(F.concat(F.lit("x"), g)).alias("negative_rels"), F.array().cast("array<string>").alias("grounds_rels"))
    rel = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "likes").when(F.col("c_acctbal") > 0, F.concat(F.lit("f"), F.col("c_nationkey"))).otherwise(F.concat(F.lit("x"), F.col("c_nationkey")))
    edges = t.customer.select(F.col("c_nationkey").alias("graph_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), rel.alias("rel"), F.col("c_mktsegment").alias("dst"))
    includes = t.nation.select(((g + 1) % 25).alias("host"), g.alias("guest"))
    return include_edges(graphs, edges, includes)


@query("u3_null_recycling", f"""WITH RECURSIVE {NATION_GRAPH_SQL}, u AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), w(node) AS (SELECT goal FROM gr UNION SELECT u.b FROM w JOIN u ON u.a = w.node)
 SELECT graph_id, node FROM nd WHERE layer = 'concept' AND node NOT IN (SELECT node FROM w)""")
def u3(t: Tables):
    """Concepts not connected to their goal become null-class rows."""
    graphs, nodes, edges = nation_graphs(t)
    comp = G.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    good = comp.join(graphs.select(F.col("goal").alias("node")), "node").select("comp").distinct()
    related = comp.join(good, "comp", "left_semi").select("node").unionByName(graphs.select(F.col("goal").alias("node"))).distinct()
    return nodes.filter("layer = 'concept'").join(related, "node", "left_anti").select("graph_id", "node")


@query("a18_dup_knowledge", """WITH n AS (SELECT DISTINCT p_name AS node, p_brand AS g FROM part), k AS (SELECT node, string_agg(g, ',' ORDER BY g) AS graphs, count(*) AS c FROM n GROUP BY node)
 SELECT graphs, count(*) AS shared FROM k WHERE c >= 2 AND node NOT LIKE 'small%' GROUP BY graphs HAVING count(*) >= 1""")
def a18(t: Tables):
    """Part names shared by the same set of brands; names starting with small count as a null class."""
    from ..operators.tables import dup_knowledge

    nodes = t.part.select(F.col("p_brand").alias("graph_id"), F.col("p_name").alias("node"), F.col("p_name").startswith("small").alias("is_null"))
    return dup_knowledge(nodes, min_shared=1)


# --- direction of edges ---

# A customer with money supports its segment in the nation's graph, one without counters it; segments support the goal
# or counter it, and richer segments support others of the same nation, in a circle too.
DIRECTION_SQL = """ce AS (SELECT 'c' || c_custkey AS a, c_nationkey || c_mktsegment AS b, c_acctbal <= 0 AS counters, c_nationkey AS g FROM customer),
 sg AS (SELECT c_nationkey AS g, c_mktsegment AS m, sum(c_acctbal) AS s FROM customer GROUP BY ALL),
 se AS (SELECT x.g || x.m AS a, y.g || y.m AS b, x.s < 5000 AS counters FROM sg x JOIN sg y ON x.g = y.g AND x.m <> y.m AND (x.s > 2 * y.s OR x.m[1] = y.m[1])),
 ge AS (SELECT g || m AS a, 'g' || g AS b, m = 'FURNITURE' AS counters FROM sg),
 ed AS (SELECT a || '>' || b AS edge, a, b, counters FROM (SELECT a, b, counters FROM ce UNION ALL SELECT * FROM se UNION ALL SELECT * FROM ge)),
 nd AS (SELECT DISTINCT a AS node FROM ed UNION SELECT b FROM ed), fw AS (SELECT a, b FROM ed WHERE NOT counters)"""


def direction_inputs(t: Tables):
    """(edges, nodes, goals, requirements) as in the SQL above."""
    c = F.col
    name = lambda g, m: F.concat(c(g).cast("string"), c(m))
    cust = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("a"), name("c_nationkey", "c_mktsegment").alias("b"), (c("c_acctbal") <= 0).alias("counters"))
    sums = t.customer.groupBy(c("c_nationkey").alias("g"), c("c_mktsegment").alias("m")).agg(F.sum("c_acctbal").alias("s"))
    other = sums.toDF("g", "m2", "s2")
    between = sums.join(other, "g").filter((c("m") != c("m2")) & ((c("s") > 2 * c("s2")) | (F.substring("m", 1, 1) == F.substring("m2", 1, 1))))
    between = between.select(name("g", "m").alias("a"), name("g", "m2").alias("b"), (c("s") < 5000).alias("counters"))
    up = sums.select(name("g", "m").alias("a"), F.concat(F.lit("g"), "g").alias("b"), (c("m") == "FURNITURE").alias("counters"))
    edges = cust.unionByName(between).unionByName(up).select(F.concat("a", F.lit(">"), "b").alias("edge"), "a", "b", "counters", (~c("counters")).alias("forward"))
    layer = F.when(c("node").startswith("c"), "instance").otherwise("concept")
    nodes = edges.select(c("a").alias("node")).union(edges.select("b")).distinct().select("node", layer.alias("layer"), c("node").alias("phrase"))
    return edges, nodes, up.select(c("b").alias("node")), up.filter("NOT counters").select(c("a").alias("node"))


@query("m2b_direction_features", f"""WITH RECURSIVE {DIRECTION_SQL},
 ra(edge, a, b, node) AS (SELECT ed.edge, ed.a, ed.b, fw.b FROM ed JOIN fw ON fw.a = ed.a AND fw.b <> ed.b UNION SELECT ra.edge, ra.a, ra.b, fw.b FROM ra JOIN fw ON fw.a = ra.node AND NOT (fw.a = ra.a AND fw.b = ra.b)),
 rb(edge, a, b, node) AS (SELECT ed.edge, ed.a, ed.b, fw.b FROM ed JOIN fw ON fw.a = ed.b UNION SELECT rb.edge, rb.a, rb.b, fw.b FROM rb JOIN fw ON fw.a = rb.node AND NOT (fw.a = rb.a AND fw.b = rb.b)),
 dg AS (SELECT n, count(*) AS d FROM (SELECT a AS n FROM ed UNION ALL SELECT b FROM ed) GROUP BY n), na AS (SELECT edge, count(*) AS n FROM ra GROUP BY edge), nb AS (SELECT edge, count(*) AS n FROM rb GROUP BY edge)
 SELECT ed.edge, ed.a, ed.b, counters, x.d AS a_degree, y.d AS b_degree, (ed.b[1] = 'g')::INT AS b_goal, (ed.b IN (SELECT a FROM ge WHERE NOT counters))::INT AS b_required,
  (ed.a[1] <> 'c')::INT AS a_concept, (ed.b[1] <> 'c')::INT AS b_concept, coalesce(na.n, 0) AS a_reach, coalesce(nb.n, 0) AS b_reach, contains(ed.a, 'MACH')::INT AS a_says_0, contains(ed.b, 'MACH')::INT AS b_says_0
 FROM ed JOIN dg x ON x.n = ed.a JOIN dg y ON y.n = ed.b LEFT JOIN na USING (edge) LEFT JOIN nb USING (edge)""")
def m2b(t: Tables):
    from ..operators.learn import direction_features

    return direction_features(*direction_inputs(t), markers=["MACH"])


@query("m2_direction_classifier")
def m2(t: Tables):
    """Every edge judged by a model that has learned from all of them, each measured as if it were not there."""
    from ..operators.learn import direction_classifier, direction_features, suggest
    from ..session import materialize

    rows = materialize(direction_features(*direction_inputs(t), markers=["MACH"]), "features")
    return suggest(direction_classifier(rows), rows).select("edge", F.round("p", 4).alias("p"), "relation")
