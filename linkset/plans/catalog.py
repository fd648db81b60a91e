"""Registered queries and their DuckDB oracles.

Every query reads whole test tables (through the graph views of
:mod:`linkset.plans.testgraphs`) and returns a DataFrame whose column names
and types match its oracle: ids BIGINT, rounds/depths INTEGER, counts BIGINT,
id lists as ascending ``;``-joined text.

The oracle SQL is written independently of the Spark code: labels by a
recursive query that keeps one row per node, the rounds by unrolling the round definition
of SURVEY §0.1 as plain CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkset.functions.columns import sorted_text
from linkset.operators import contract as C
from linkset.operators import graph as G
from linkset.operators import ids as I
from linkset.operators import propagate as P
from linkset.operators import seeds as SD
from linkset.operators import stars as ST
from linkset.operators.merge import merge_components
from linkset.plans import testgraphs as TG
from linkset.plans.solve import connected_components
from linkset.plans.workspace import Workspace
from linkset.sources import edges as SRC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HUB_THRESHOLD = 32
ORACLE_ROUNDS = 8   # unrolled rounds in the SQL oracle; the test graphs need at most 5


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


# -- shared Spark pieces ------------------------------------------------------------

def contraction(spark: SparkSession, sf_dir: str, graph: str, **kw) -> C.ContractionResult:
    return C.contract(TG.GRAPHS[graph](spark, sf_dir), **kw)


def _ws(spark: SparkSession, label: str) -> Workspace:
    return Workspace(spark, label=label)


def order_part_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-part links with their repeats (one per line item)."""
    li = TG.table(spark, sf_dir, "lineitem")
    return (li.select((F.col("l_orderkey") * 2).alias("src"),
                      (F.col("l_partkey") * 2 + 1).alias("dst")))


# -- shared SQL pieces ----------------------------------------------------------------

def _g(graph: str) -> str:
    return f"g0 AS ({TG.GRAPH_SQL[graph]})"


OP_RAW = "SELECT l_orderkey*2 AS src, l_partkey*2+1 AS dst FROM lineitem"
SYM = "e AS (SELECT src, dst FROM g0 UNION SELECT dst AS src, src AS dst FROM g0)"
VERTS = "v AS (SELECT src AS node FROM g0 UNION SELECT dst AS node FROM g0)"
# one row per node, lowered until nothing changes
LABELS = (
    "lab(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM e UNION "
    "SELECT e.dst, min(lab.component) FROM lab JOIN e ON e.src = lab.node "
    "JOIN recurring.lab AS o ON o.node = e.dst WHERE lab.component < o.component GROUP BY e.dst)")


def _rounds(n: int = ORACLE_ROUNDS, flags: bool = False) -> str:
    """SURVEY §0.1 unrolled: g1 = e; tree/seeds/log over all rounds. With
    ``flags``, e has a column ``active`` that every regrouping combines by AND.
    Edges left after ``n`` rounds appear as tree rows, which no result has."""
    def act(source: str) -> str:
        return f", bool_and({source}) AS active" if flags else ""

    f, seed = (", active", " AND active") if flags else ("", "")
    once = "GROUP BY ALL" if flags else ""
    distinct = "" if flags else "DISTINCT "
    parts = [f"g1 AS (SELECT src, dst{f} FROM e)"]
    for r in range(1, n + 1):
        m = f", m{r}.active" if flags else ""
        parts += [
            f"m{r} AS (SELECT src AS node, least(src, min(dst)) AS m{act('active')} FROM g{r} GROUP BY src)",
            f"h{r} AS (SELECT {distinct}node, w{act('active')} FROM (SELECT g{r}.dst AS node, m{r}.m AS w{m} "
            f"FROM g{r} JOIN m{r} ON g{r}.src = m{r}.node UNION ALL SELECT node, m AS w{f} FROM m{r}) {once})",
            f"q{r} AS (SELECT node, min(w) AS vm, count(*) AS cnt, bool_or(w = node) AS is_self{act('active')} "
            f"FROM h{r} GROUP BY node)",
            f"d{r} AS (SELECT q{r}.vm AS src, h{r}.w AS dst{f and f', q{r}.active'} FROM h{r} "
            f"JOIN q{r} ON h{r}.node = q{r}.node WHERE h{r}.w <> q{r}.vm)",
            f"g{r + 1} AS (SELECT {distinct}src, dst{act('active')} FROM (SELECT src, dst{f} FROM d{r} "
            f"UNION ALL SELECT dst AS src, src AS dst{f} FROM d{r}) {once})",
            f"t{r} AS (SELECT vm AS parent, node AS child, CAST({r} AS INTEGER) AS round FROM q{r} "
            f"WHERE NOT is_self)",
            f"s{r} AS (SELECT node, CAST({r} AS INTEGER) AS round FROM q{r} WHERE cnt = 1 AND is_self{seed} "
            f"AND NOT EXISTS (SELECT 1 FROM g{r + 1} WHERE g{r + 1}.src = q{r}.node))",
        ]
    parts.append("tree AS (" + " UNION ALL ".join(f"SELECT * FROM t{r}" for r in range(1, n + 1)) +
                 f" UNION ALL SELECT src, dst, CAST({n + 1} AS INTEGER) FROM g{n + 1})")
    parts.append("seeds AS (" + " UNION ALL ".join(f"SELECT * FROM s{r}" for r in range(1, n + 1)) +
                 f" UNION ALL SELECT src, CAST({n + 1} AS INTEGER) FROM g{n + 1})")
    parts.append("log AS (" + " UNION ALL ".join(
        f"SELECT CAST({r} AS INTEGER) AS round, (SELECT count(*) FROM g{r}) AS edges, "
        f"(SELECT count(*) FROM t{r}) AS tree_rows, (SELECT count(*) FROM s{r}) AS seeds"
        for r in range(1, n + 1)) + ")")
    return ", ".join(parts)


DEPTH = ("dep(node, component, depth) AS (SELECT node, node, CAST(0 AS INTEGER) FROM seeds "
         "UNION ALL SELECT tree.child, dep.component, CAST(dep.depth + 1 AS INTEGER) "
         "FROM tree JOIN dep ON tree.parent = dep.node)")


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


# -- S: sources and sinks --------------------------------------------------------------

def _write_read(spark, sf_dir, lines: DataFrame, reader) -> DataFrame:
    ws = _ws(spark, "io")
    path = f"{ws.root}/edges"
    lines.write.mode("errorifexists").text(path)
    return reader(path)


@query("edges_csv", _with(_g("order_part")) + "SELECT src, dst FROM g0")
def q_edges_csv(spark, sf_dir):
    e = TG.order_part(spark, sf_dir)
    ws = _ws(spark, "io")
    path = f"{ws.root}/csv"
    # a third field (a weight) on every line, as in weighted edge files; it is ignored
    SRC.write_edges(e.select("src", F.concat(F.lit(" "), "dst", F.lit(" ")).alias("dst"),
                             (F.col("src") + F.col("dst")).alias("w")), path)
    return SRC.read_edges(spark, path, ",")


@query("edges_tsv", _with(_g("order_part")) + "SELECT src, dst FROM g0")
def q_edges_tsv(spark, sf_dir):
    e = TG.order_part(spark, sf_dir)
    lines = e.select(F.concat_ws("\t", F.concat(F.lit(" "), "src"), F.concat("dst", F.lit(" ")),
                                 F.lit("1")).alias("value"))
    return _write_read(spark, sf_dir, lines, lambda p: SRC.read_edges(spark, p, "tab"))


@query("edges_space", _with(_g("order_part")) + "SELECT src, dst FROM g0")
def q_edges_space(spark, sf_dir):
    e = TG.order_part(spark, sf_dir)
    lines = e.select(F.concat(F.lit(" "), "src", F.lit("  "), "dst", F.lit(" x")).alias("value"))
    return _write_read(spark, sf_dir, lines, lambda p: SRC.read_edges(spark, p, "space"))


@query("edges_whitespace", _with(_g("order_part")) + "SELECT src, dst FROM g0")
def q_edges_whitespace(spark, sf_dir):
    e = TG.order_part(spark, sf_dir)
    lines = e.select(F.concat(F.lit("\t "), F.col("src").cast("string"), F.lit(" \t  "),
                              F.col("dst").cast("string"), F.lit("\t")).alias("value"))
    return _write_read(spark, sf_dir, lines, lambda p: SRC.read_edges_whitespace(spark, p))


@query("edges_rows", _with(_g("order_part")) + "SELECT src, dst FROM g0")
def q_edges_rows(spark, sf_dir):
    """An RDD that a job has anyway: pairs parsed from a text file."""
    path = f"{_ws(spark, 'io').root}/rdd"
    SRC.write_edges(TG.order_part(spark, sf_dir), path)
    pairs = spark.sparkContext.textFile(path).map(lambda line: tuple(map(int, line.split(","))))
    return SRC.edges_from_rdd(spark, pairs)


@query("edges_isolated",
       _with(_g("order_part")) + "SELECT src, dst FROM g0 UNION ALL "
       "SELECT p_partkey*2+1 AS src, p_partkey*2+1 AS dst FROM part")
def q_edges_isolated(spark, sf_dir):
    e = TG.order_part(spark, sf_dir)
    parts = TG.table(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("p"))
    lines = (e.select(F.concat_ws(" ,", "src", "dst").alias("value"))
              .unionByName(parts.select(F.concat(F.lit("\t"), "p", F.lit("  ")).alias("value"))))
    return _write_read(spark, sf_dir, lines, lambda p: SRC.read_edges(spark, p, ","))


@query("edges_rejected",
       _with(_g("order_part")) +
       "SELECT src, dst, CAST(NULL AS VARCHAR) AS line, CAST(NULL AS VARCHAR) AS reason FROM g0 UNION ALL "
       "SELECT NULL, NULL, p_name || ',' || p_partkey, 'first field is no id' FROM part UNION ALL "
       "SELECT NULL, NULL, s_suppkey || ',\"' || s_name || '\"', 'second field is no id' FROM supplier UNION ALL "
       "SELECT NULL, NULL, ',' || c_custkey, 'first field is no id' FROM customer")
def q_edges_rejected(spark, sf_dir):
    """A file with lines that are no edges: they come back as a table, the edges are whole."""
    t = lambda name, *cols: TG.table(spark, sf_dir, name).select(F.concat(*cols).alias("value"))
    comma, quote = F.lit(","), F.lit('"')
    lines = (TG.order_part(spark, sf_dir).select(F.concat("src", comma, "dst").alias("value"))
             .unionByName(t("part", "p_name", comma, "p_partkey"))
             .unionByName(t("supplier", "s_suppkey", comma, quote, "s_name", quote))
             .unionByName(t("customer", comma, "c_custkey")))
    found = _write_read(spark, sf_dir, lines, lambda p: SRC.read_edges(spark, p, on_bad="keep"))
    return found.edges.unionByName(found.rejected.select("line", "reason"), allowMissingColumns=True)


@query("strings_quoted",
       "SELECT '\"' || c_name AS src, n_name || '\"' AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey "
       "UNION ALL SELECT '\"' || s_name || '\"', s_name || '\\' FROM supplier "
       "UNION ALL SELECT ' ' || p_name || ' ', NULL FROM part")
def q_strings_quoted(spark, sf_dir):
    """Names with quotes, blanks and backslashes, and lines of one name, tab-separated."""
    tab, quote = F.lit("\t"), F.lit('"')
    lines = (TG.cust_nation_names(spark, sf_dir).select(F.concat(quote, "src", tab, "dst", quote).alias("value"))
             .unionByName(TG.table(spark, sf_dir, "supplier").select(
                 F.concat(quote, "s_name", quote, tab, "s_name", F.lit("\\\tmore")).alias("value")))
             .unionByName(TG.table(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("value"))))
    return _write_read(spark, sf_dir, lines, lambda p: SRC.read_string_edges(spark, p, "tab"))


@query("adjacency_text",
       _with(_g("order_part"), SYM) +
       "SELECT src AS node, CAST(src AS VARCHAR) || chr(9) || "
       "string_agg(CAST(dst AS VARCHAR), ';' ORDER BY dst) AS line FROM e GROUP BY src")
def q_adjacency_text(spark, sf_dir):
    lines = G.adjacency_text(G.normalize(TG.order_part(spark, sf_dir)))
    ws = _ws(spark, "io")
    path = f"{ws.root}/adjacency"
    SRC.write_adjacency_text(lines, path)
    back = spark.read.text(path)
    return back.select(F.split("value", "\t").getItem(0).cast("long").alias("node"),
                       F.col("value").alias("line"))


# -- G: construction and inspection ----------------------------------------------------

@query("edges_symmetric",
       _with(_g("order_part")) + "SELECT src, dst FROM g0 UNION ALL SELECT dst, src FROM g0")
def q_edges_symmetric(spark, sf_dir):
    return G.symmetrize(TG.order_part(spark, sf_dir))


@query("edges_distinct",
       f"WITH g0 AS ({OP_RAW}) SELECT src, dst FROM g0 UNION SELECT dst, src FROM g0")
def q_edges_distinct(spark, sf_dir):
    return G.normalize(order_part_raw(spark, sf_dir))


@query("directed_edges", f"SELECT DISTINCT src, dst FROM ({OP_RAW})")
def q_directed_edges(spark, sf_dir):
    return G.distinct_edges(G.directed(order_part_raw(spark, sf_dir)))


@query("vertices", _with(_g("order_part"), VERTS) + "SELECT node FROM v")
def q_vertices(spark, sf_dir):
    return G.vertices(TG.order_part(spark, sf_dir))


@query("graph_counts",
       f"WITH g0 AS ({OP_RAW}) SELECT (SELECT count(*) FROM g0) AS edge_rows, "
       "(SELECT count(*) FROM (SELECT DISTINCT src, dst FROM g0)) AS distinct_edges, "
       "(SELECT count(*) FROM (SELECT src FROM g0 UNION SELECT dst FROM g0)) AS vertex_count")
def q_graph_counts(spark, sf_dir):
    return G.graph_counts(order_part_raw(spark, sf_dir))


@query("adjacency_active",
       _with(_g("order_part"), SYM) +
       "SELECT src AS node, CAST(0 AS BIGINT) AS block, "
       "string_agg(CAST(dst AS VARCHAR), ';' ORDER BY dst) AS nn, TRUE AS active FROM e GROUP BY src")
def q_adjacency_active(spark, sf_dir):
    adj = G.with_activity(G.adjacency(G.normalize(TG.order_part(spark, sf_dir))))
    return adj.select("node", "block", sorted_text("nn").alias("nn"), "active")


@query("star_expand",
       _with(_g("order_part"), VERTS) +
       "SELECT CAST(-1 AS BIGINT) AS src, node AS dst FROM v "
       "UNION ALL SELECT node AS src, CAST(-1 AS BIGINT) AS dst FROM v")
def q_star_expand(spark, sf_dir):
    nodes = G.vertices(TG.order_part(spark, sf_dir))
    return G.star_edges(-1, nodes, both=True)


@query("neighbour_lookup",
       _with(_g("order_part"), SYM) +
       "SELECT e.src AS node, e.dst AS neighbour FROM e "
       "WHERE e.src IN (SELECT o_orderkey*2 FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_neighbour_lookup(spark, sf_dir):
    urgent = (TG.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
              .select((F.col("o_orderkey") * 2).alias("node")))
    return G.neighbours(G.normalize(TG.order_part(spark, sf_dir)), urgent)


@query("peek_edges", _with(_g("order_part")) + "SELECT src, dst FROM g0 ORDER BY src, dst LIMIT 10")
def q_peek_edges(spark, sf_dir):
    return G.peek(TG.order_part(spark, sf_dir), 10)


@query("sample_nodes", _with(_g("order_part"), VERTS) +
       "SELECT node FROM v ORDER BY md5('123:' || CAST(node AS VARCHAR)), node LIMIT 10")
def q_sample_nodes(spark, sf_dir):
    return G.sample_rows(G.vertices(TG.order_part(spark, sf_dir)), 10, seed=123)


NAMES_SQL = ("g0 AS (SELECT c_name AS src, n_name AS dst FROM customer "
             "JOIN nation ON c_nationkey = n_nationkey), "
             "names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM "
             "(SELECT src AS name FROM g0 UNION SELECT dst AS name FROM g0))")


@query("dense_ids", f"WITH {NAMES_SQL} SELECT name, id FROM names")
def q_dense_ids(spark, sf_dir):
    return I.dense_ids(I.node_names(TG.cust_nation_names(spark, sf_dir)))


@query("edges_relabelled",
       f"WITH {NAMES_SQL} SELECT a.id AS src, b.id AS dst FROM g0 "
       "JOIN names a ON g0.src = a.name JOIN names b ON g0.dst = b.name")
def q_edges_relabelled(spark, sf_dir):
    e = TG.cust_nation_names(spark, sf_dir)
    return I.relabel(e, I.dense_ids(I.node_names(e)))


@query("disjoint_copies",
       _with(_g("order_part")) +
       "SELECT g0.src + t.i * o.off AS src, g0.dst + t.i * o.off AS dst FROM g0 "
       "CROSS JOIN (SELECT CAST(range AS BIGINT) AS i FROM range(3)) t "
       "CROSS JOIN (SELECT max(greatest(src, dst)) - min(least(src, dst)) + 1 AS off FROM g0) o")

def q_disjoint_copies(spark, sf_dir):
    return G.disjoint_copies(TG.order_part(spark, sf_dir), 3)


@query("copies_components", _with(_g("part_supp"), SYM, LABELS) +
       "SELECT 3 * count(DISTINCT component) AS components FROM lab")
def q_copies_components(spark, sf_dir):
    """Copies never touch: three times the components, also with negative ids."""
    e = TG.part_supp(spark, sf_dir).select((-F.col("src")).alias("src"), "dst")
    return C.component_count(C.contract(G.disjoint_copies(e, 3)).seeds)


# -- C: contraction --------------------------------------------------------------------

def _first_round(spark, sf_dir, graph="order_part", keep=False):
    """The graph and its minima are written, for each is read more than once; H is
    written by a query that needs both it and what is made of it."""
    ws = _ws(spark, "round")
    g = ws.save(G.normalize(TG.GRAPHS[graph](spark, sf_dir)), "graph")
    m = ws.save(C.local_minima(g), "minima")
    h = C.min_selection(g, m)
    if keep:
        h = ws.save(h, "sent")
    q = C.summarize(h)
    return g, h, ws.save(q, "nodes") if keep else q


_OP_ROUNDS = _with(_g("order_part"), SYM, _rounds())
_CH_ROUNDS = _with(_g("order_chain"), SYM, _rounds())
_PS_ROUNDS = _with(_g("part_supp"), SYM, _rounds())


@query("min_selection", _OP_ROUNDS + "SELECT node, w FROM h1")
def q_min_selection(spark, sf_dir):
    return _first_round(spark, sf_dir)[1]


@query("root_candidates", _OP_ROUNDS + "SELECT node FROM q1 WHERE cnt <= 1 AND is_self")
def q_root_candidates(spark, sf_dir):
    return C.root_candidates(_first_round(spark, sf_dir)[2])


@query("prune_next_graph", _OP_ROUNDS + "SELECT src, dst FROM g2")
def q_prune_next_graph(spark, sf_dir):
    _, h, q = _first_round(spark, sf_dir, keep=True)
    return C.prune(h, q)


@query("deactivated", _OP_ROUNDS + "SELECT parent, child, round FROM t1")
def q_deactivated(spark, sf_dir):
    return C.deactivated(_first_round(spark, sf_dir)[2], 1)


@query("propagation_tree", _OP_ROUNDS + "SELECT parent, child, round FROM tree")
def q_propagation_tree(spark, sf_dir):
    return contraction(spark, sf_dir, "order_part").tree


@query("propagation_tree_chain", _CH_ROUNDS + "SELECT parent, child, round FROM tree")
def q_propagation_tree_chain(spark, sf_dir):
    return contraction(spark, sf_dir, "order_chain").tree


@query("tree_children",
       _OP_ROUNDS + "SELECT parent, CAST(0 AS BIGINT) AS block, "
       "string_agg(CAST(child AS VARCHAR), ';' ORDER BY child) AS children FROM tree GROUP BY parent")
def q_tree_children(spark, sf_dir):
    t = C.tree_children(contraction(spark, sf_dir, "order_part").tree)
    return t.select("parent", "block", sorted_text("children").alias("children"))


@query("seeds_tracked", _OP_ROUNDS + "SELECT node, round FROM seeds")
def q_seeds_tracked(spark, sf_dir):
    return contraction(spark, sf_dir, "order_part").seeds


@query("seeds_active", _OP_ROUNDS + "SELECT node, round FROM seeds")
def q_seeds_active(spark, sf_dir):
    return contraction(spark, sf_dir, "order_part", activity=True).seeds


_IDLE = "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000"


@query("seeds_inactive",
       _with(_g("order_chain"),
             f"e AS (SELECT src, dst, src NOT IN ({_IDLE}) AS active FROM "
             "(SELECT src, dst FROM g0 UNION SELECT dst AS src, src AS dst FROM g0))", _rounds(flags=True)) +
       "SELECT node, round FROM seeds")
def q_seeds_inactive(spark, sf_dir):
    """Large urgent orders start inactive: components that hold one have no seed."""
    idle = (TG.table(spark, sf_dir, "orders")
            .where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
            .select(F.col("o_orderkey").alias("src"), F.lit(False).alias("active")))
    g = G.normalize(TG.order_chain(spark, sf_dir)).join(idle, "src", "left")
    return C.contract(g.select("src", "dst", F.coalesce("active", F.lit(True)).alias("active")),
                      normalized=True, activity=True).seeds


_TREE_SEEDS = _OP_ROUNDS + ("SELECT DISTINCT parent AS node FROM tree "
                            "WHERE parent NOT IN (SELECT child FROM tree)")


@query("seeds_antijoin", _TREE_SEEDS)
def q_seeds_antijoin(spark, sf_dir):
    return SD.seeds_antijoin(contraction(spark, sf_dir, "order_part").tree)


@query("seeds_except", _TREE_SEEDS)
def q_seeds_except(spark, sf_dir):
    return SD.seeds_except(contraction(spark, sf_dir, "order_part").tree)


@query("seeds_outer", _TREE_SEEDS)
def q_seeds_outer(spark, sf_dir):
    return SD.seeds_outer(contraction(spark, sf_dir, "order_part").tree)


@query("round_log", _CH_ROUNDS + "SELECT round, edges, tree_rows, seeds FROM log WHERE edges > 0")
def q_round_log(spark, sf_dir):
    return contraction(spark, sf_dir, "order_chain").log_frame()


@query("component_count",
       _with(_g("order_chain"), SYM, LABELS) + "SELECT count(DISTINCT component) AS components FROM lab")
def q_component_count(spark, sf_dir):
    return C.component_count(contraction(spark, sf_dir, "order_chain").seeds)


def _labels_sql(graph: str) -> str:
    return _with(_g(graph), SYM, LABELS) + "SELECT node, component FROM lab"


@query("cc_contract", _labels_sql("order_part"))
def q_cc_contract(spark, sf_dir):
    return connected_components(TG.order_part(spark, sf_dir))


@query("cc_broadcast", _labels_sql("part_supp"))
def q_cc_broadcast(spark, sf_dir):
    return connected_components(TG.part_supp(spark, sf_dir), prune_strategy="broadcast",
                                seed_strategy="broadcast")


@query("cc_shuffle", _labels_sql("part_supp"))
def q_cc_shuffle(spark, sf_dir):
    return connected_components(TG.part_supp(spark, sf_dir), prune_strategy="shuffle",
                                seed_strategy="shuffle")


@query("cc_broadcast_prune", _labels_sql("part_supp"))
def q_cc_broadcast_prune(spark, sf_dir):
    return connected_components(TG.part_supp(spark, sf_dir), prune_strategy="broadcast",
                                seed_strategy="shuffle")


@query("cc_broadcast_seeds", _labels_sql("part_supp"))
def q_cc_broadcast_seeds(spark, sf_dir):
    return connected_components(TG.part_supp(spark, sf_dir), prune_strategy="shuffle",
                                seed_strategy="broadcast")


@query("cc_hubs", _labels_sql("part_supp"))
def q_cc_hubs(spark, sf_dir):
    """Suppliers have far more parts than the threshold: the hub path in every round."""
    return connected_components(TG.part_supp(spark, sf_dir), hot_threshold=HUB_THRESHOLD)


@query("cc_stars_hubs", _labels_sql("part_supp"))
def q_cc_stars_hubs(spark, sf_dir):
    return ST.star_components(TG.part_supp(spark, sf_dir), hot_threshold=HUB_THRESHOLD).components


@query("cc_order_chain", _labels_sql("order_chain"))
def q_cc_order_chain(spark, sf_dir):
    return connected_components(TG.order_chain(spark, sf_dir))


@query("cc_cust_nation", _labels_sql("cust_nation"))
def q_cc_cust_nation(spark, sf_dir):
    return connected_components(TG.cust_nation(spark, sf_dir))


@query("cc_named",
       "WITH RECURSIVE g0 AS (SELECT c_name AS src, n_name AS dst FROM customer "
       "JOIN nation ON c_nationkey = n_nationkey), " + SYM + ", " + LABELS +
       " SELECT node AS name, component FROM lab")
def q_cc_named(spark, sf_dir):
    from linkset.plans.solve import connected_components_named
    return connected_components_named(TG.cust_nation_names(spark, sf_dir))


@query("cc_named_isolated",
       "WITH RECURSIVE g0 AS (SELECT c_name AS src, n_name AS dst FROM customer "
       "JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, s_name FROM supplier), "
       + SYM + ", " + LABELS + " SELECT node AS name, component FROM lab")
def q_cc_named_isolated(spark, sf_dir):
    """Suppliers have a name and no edge."""
    from linkset.plans.solve import connected_components_named
    alone = TG.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("src"),
                                                       F.lit(None).cast("string").alias("dst"))
    return connected_components_named(TG.cust_nation_names(spark, sf_dir).unionByName(alone))


@query("strings_to_ids_file",
       f"WITH {NAMES_SQL} SELECT a.id AS src, b.id AS dst FROM g0 "
       "JOIN names a ON g0.src = a.name JOIN names b ON g0.dst = b.name")
def q_strings_to_ids_file(spark, sf_dir):
    """A file of names becomes a file of dense ids: write, read, number, relabel, write, read."""
    ws = _ws(spark, "io")
    names, ids = f"{ws.root}/names", f"{ws.root}/ids"
    SRC.write_edges(TG.cust_nation_names(spark, sf_dir), names)
    e = SRC.read_string_edges(spark, names)
    SRC.write_edges(I.relabel(e, I.dense_ids(I.node_names(e))), ids)
    return SRC.read_edges(spark, ids)


# -- P: propagation --------------------------------------------------------------------

_CH_DEPTH = _with(_g("order_chain"), SYM, _rounds(), DEPTH)


@query("prop_triples",
       _CH_DEPTH + "SELECT tree.parent, dep.component AS seed, tree.child FROM tree "
       "JOIN dep ON tree.child = dep.node")
def q_prop_triples(spark, sf_dir):
    res = contraction(spark, sf_dir, "order_chain")
    return P.propagate_naive(res.tree, res.seeds)


@query("prop_triples_broadcast",
       _CH_DEPTH + "SELECT tree.parent, dep.component AS seed, tree.child FROM tree "
       "JOIN dep ON tree.child = dep.node")
def q_prop_triples_broadcast(spark, sf_dir):
    res = contraction(spark, sf_dir, "order_chain")
    return P.propagate_naive(res.tree, res.seeds, strategy="broadcast")


@query("prop_shrink", _CH_DEPTH + "SELECT node, component FROM dep WHERE depth > 0")
def q_prop_shrink(spark, sf_dir):
    res = contraction(spark, sf_dir, "order_chain")
    return P.propagate_shrinking(res.tree, res.seeds)


@query("prop_layers", _CH_DEPTH + "SELECT node, component FROM dep WHERE depth > 0")
def q_prop_layers(spark, sf_dir):
    res = contraction(spark, sf_dir, "order_chain")
    return P.propagate_layers(res.tree, res.seeds, include_roots=False,
                              rounds=res.rounds).select("node", "component")


@query("prop_frontier", _CH_DEPTH + "SELECT node, component, depth FROM dep")
def q_prop_frontier(spark, sf_dir):
    """The same labels without the rounds: layer by layer, hub path on."""
    res = contraction(spark, sf_dir, "order_chain")
    return P.propagate_layers(res.tree.drop("round"), res.seeds, hot_threshold=2)


@query("prop_depth", _CH_DEPTH + "SELECT node, component, depth FROM dep")
def q_prop_depth(spark, sf_dir):
    res = contraction(spark, sf_dir, "order_chain")
    return P.propagate_layers(res.tree, res.seeds, rounds=res.rounds)


@query("prop_jump", _labels_sql("order_chain"))
def q_prop_jump(spark, sf_dir):
    res = contraction(spark, sf_dir, "order_chain")
    return P.propagate_jump(res.tree, res.seeds)


@query("prop_unresolved",
       _CH_ROUNDS + "SELECT parent, child, round FROM tree "
       "WHERE parent NOT IN (SELECT node FROM seeds)")
def q_prop_unresolved(spark, sf_dir):
    res = contraction(spark, sf_dir, "order_chain")
    return P.unresolved_edges(res.tree, res.seeds)


@query("prop_direct",
       _CH_ROUNDS + "SELECT parent, child, round FROM tree WHERE parent IN (SELECT node FROM seeds)")
def q_prop_direct(spark, sf_dir):
    res = contraction(spark, sf_dir, "order_chain")
    return P.direct_edges(res.tree, res.seeds)


@query("root_lookup",
       _with(_g("order_part"), SYM, LABELS) +
       "SELECT a.node, coalesce(lab.component, a.node) AS component FROM "
       "(SELECT DISTINCT o_orderkey*2 AS node FROM orders) a LEFT JOIN lab ON a.node = lab.node")
def q_root_lookup(spark, sf_dir):
    asked = TG.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("node"))
    res = contraction(spark, sf_dir, "order_part")
    return P.root_of(asked, P.components_from(res.tree, res.seeds, rounds=res.rounds, rows=res.tree_rows))


# -- L: large-star / small-star ----------------------------------------------------------

_STAR1 = ("mn AS (SELECT src, least(src, min(dst)) AS mn FROM e GROUP BY src), "
          "large AS (SELECT DISTINCT e.dst AS src, mn.mn AS dst FROM e JOIN mn ON e.src = mn.src "
          "WHERE e.dst > e.src)")
_STAR2 = ("o AS (SELECT DISTINCT greatest(src, dst) AS src, least(src, dst) AS dst FROM large), "
          "mo AS (SELECT src, least(src, min(dst)) AS mn FROM o GROUP BY src), "
          "small AS (SELECT DISTINCT x AS src, mn AS dst FROM (SELECT o.dst AS x, mo.mn FROM o "
          "JOIN mo ON o.src = mo.src UNION ALL SELECT src AS x, mn FROM mo) WHERE x <> mn)")


@query("large_star", _with(_g("order_part"), SYM, _STAR1) + "SELECT src, dst FROM large")
def q_large_star(spark, sf_dir):
    return ST.large_star(G.normalize(TG.order_part(spark, sf_dir)))


@query("small_star", _with(_g("order_part"), SYM, _STAR1, _STAR2) + "SELECT src, dst FROM small")
def q_small_star(spark, sf_dir):
    return ST.small_star(ST.large_star(G.normalize(TG.order_part(spark, sf_dir))))


def _stars(spark, sf_dir, graph="order_part") -> ST.StarResult:
    return ST.star_components(TG.GRAPHS[graph](spark, sf_dir))


@query("cc_stars", _labels_sql("order_part"))
def q_cc_stars(spark, sf_dir):
    return _stars(spark, sf_dir).components


@query("cc_stars_chain", _labels_sql("order_chain"))
def q_cc_stars_chain(spark, sf_dir):
    return _stars(spark, sf_dir, "order_chain").components


@query("component_members",
       _with(_g("order_part"), SYM, LABELS) +
       "SELECT component, CAST(0 AS BIGINT) AS block, "
       "string_agg(CAST(node AS VARCHAR), ';' ORDER BY node) AS members FROM lab GROUP BY component")
def q_component_members(spark, sf_dir):
    m = ST.members(_stars(spark, sf_dir).components)
    return m.select("component", "block", sorted_text("members").alias("members"))


@query("component_sizes",
       _with(_g("order_part"), SYM, LABELS) +
       "SELECT component, count(*) AS size FROM lab GROUP BY component")
def q_component_sizes(spark, sf_dir):
    return ST.sizes(_stars(spark, sf_dir).components)


# -- M: merge of partial results -----------------------------------------------------------

@query("merge_components", _labels_sql("order_part"))
def q_merge_components(spark, sf_dir):
    li = TG.table(spark, sf_dir, "lineitem")
    early = F.coalesce(F.year("l_shipdate") < 1998, F.lit(False))

    def batch(cond):
        return (li.where(cond).select((F.col("l_orderkey") * 2).alias("src"),
                                      (F.col("l_partkey") * 2 + 1).alias("dst")).distinct())
    a = connected_components(batch(early))
    b = connected_components(batch(~early))
    return merge_components(a, b)


@query("merge_edges", _labels_sql("order_part"))
def q_merge_edges(spark, sf_dir):
    """The components of one half, and the edges of the other."""
    li = TG.table(spark, sf_dir, "lineitem")
    half = li.where(F.year("l_shipdate") < 1998)
    rest = li.where(F.coalesce(F.year("l_shipdate") >= 1998, F.lit(True)))
    pair = lambda d: d.select((F.col("l_orderkey") * 2).alias("src"),
                              (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()
    return merge_components(connected_components(pair(half)), extra_edges=pair(rest))
