"""Contraction by min-selection and pruning.

One round over a symmetric edge table ``g(src, dst)``::

    m(u)   = min({u} ∪ N(u))                             local_minima
    H      = {(v, m(u)) : v ∈ N(u) ∪ {u}}                min_selection
    q(u)   = min H(u), |H(u)| = 1, u ∈ H(u)              summarize
    G'     = {(vm(u), w), (w, vm(u)) : w ∈ H(u) \\ vm(u)}  prune
    T     += {(vm(u), u) : u ∉ H(u)}                     deactivated
    Seeds += {u : H(u) = {u}, u ∉ G'}                    contract

Everything stays flat (one row per edge, never a neighbour array). The steps
above are operators of their own. The loop (:func:`contract`) runs the same
definitions in one pass and one write a round: dealt by ``src``, a window has each
edge's minimum beside it; dealt by node, another window has all that H says of a
node beside each of its rows. G is read once, its rows are exchanged three times
(by src, by node, and to be distinct), and H and q are never written. G is
held with each edge once, smaller end first, and turned where it is read.
Nodes with more than ``hot_threshold`` rows are kept out of the windows:
their rows stay where they are and meet a broadcast of the few hot nodes' values.
With an explicit join strategy the loop joins per-node tables instead,
through :func:`join_keyed`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkset.operators.graph import both_ways, distinct_edges, undirected
from linkset.operators.lists import LIST_ROWS, id_lists
from linkset.plans.joins import HOT_KEY_ROWS, hot_keys, join_keyed, over_threshold
from linkset.plans.workspace import Workspace, dealt


# -- one round, step by step --------------------------------------------------

def local_minima(g: DataFrame, activity: bool = False) -> DataFrame:
    """``(node, m, deg[, active])``: own-or-neighbour minimum and degree."""
    act = ["bool_and(active) AS active"] if activity else []
    return (g.groupBy("src")
             .agg(*(F.expr(e) for e in ["min(dst) AS _mn", "count(1) AS deg", *act]))
             .selectExpr("src AS node", "least(src, _mn) AS m", "deg",
                         *(["active"] if activity else [])))


def _sent(g: DataFrame, m: DataFrame, strategy: str = "auto", activity: bool = False,
          hot_threshold: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """H as a bag: ``(node, w[, active])`` — each node sends m(u) to itself and
    to its neighbours. Repeats are harmless for every later step."""
    keyed = m.selectExpr("node AS src", "m", *(["active AS m_active"] if activity else []))
    hot = (None if hot_rows == 0 else
           hot_keys(m.selectExpr("node AS src", "deg"), "src", "deg", hot_threshold))
    sent = join_keyed(g.select("src", "dst"), keyed, "src", strategy=strategy, hot=hot,
                      hot_rows=hot_rows)
    return (sent.selectExpr("dst AS node", "m AS w", *(["m_active AS active"] if activity else []))
                .unionByName(m.selectExpr("node", "m AS w", *(["active"] if activity else []))))


def min_selection(g: DataFrame, m: DataFrame | None = None, strategy: str = "auto",
                  activity: bool = False, hot_threshold: int | None = None) -> DataFrame:
    """``H(node, w[, active])`` as a set."""
    if m is None:
        m = local_minima(g, activity)
    h = _sent(g, m, strategy, activity, hot_threshold)
    if activity:
        return h.groupBy("node", "w").agg(F.bool_and("active").alias("active"))
    return h.dropDuplicates(["node", "w"])


def summarize(h: DataFrame, activity: bool = False) -> DataFrame:
    """``q(node, vm, single, self, n[, active])`` — one row per node of H.

    Only min/max/or/count, so it works on H as a bag and combines map-side:
    |H(u)| = 1 exactly when min = max. ``n`` (rows of H for the node) marks
    hot nodes for the join that follows.
    """
    aggs = ["min(w) AS vm", "max(w) AS _mx", "bool_or(w = node) AS self", "count(1) AS n"]
    if activity:
        aggs.append("bool_and(active) AS active")
    return (h.groupBy("node").agg(*(F.expr(e) for e in aggs))
             .selectExpr("node", "vm", "vm = _mx AS single", "self", "n",
                         *(["active"] if activity else [])))


def pruned_once(h: DataFrame, q: DataFrame, strategy: str = "auto", activity: bool = False,
                hot_threshold: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """The next graph G', each edge once: a node's minimum is the smaller end of its edges."""
    act = ["active"] if activity else []
    keyed = q.where("NOT single").select("node", "vm", *act)
    hot = None if hot_rows == 0 else hot_keys(q, "node", "n", hot_threshold)
    d = (join_keyed(h.select("node", "w"), keyed, "node", strategy=strategy, hot=hot,
                    hot_rows=hot_rows)
         .where("w <> vm").selectExpr("vm AS src", "w AS dst", *act))
    if activity:
        return d.groupBy("src", "dst").agg(F.expr("bool_and(active) AS active"))
    return distinct_edges(d)


def prune(h: DataFrame, q: DataFrame, strategy: str = "auto", activity: bool = False,
          hot_threshold: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """The next graph G' (symmetric, distinct). ``h`` may be a bag."""
    once = pruned_once(h, q, strategy, activity, hot_threshold, hot_rows)
    return both_ways(once, "src", "dst", *(["active"] if activity else []))


def deactivated(q: DataFrame, round_no: int = 1) -> DataFrame:
    """Tree rows ``(parent, child, round)`` for nodes that leave the graph."""
    return q.where("NOT self").selectExpr(
        "vm AS parent", "node AS child", f"CAST({int(round_no)} AS INT) AS round")


def root_candidates(q: DataFrame) -> DataFrame:
    """Nodes with |H(u)| <= 1 and u ∈ H(u)."""
    return q.where(F.col("single") & F.col("self")).select("node")


# -- the driver loop ------------------------------------------------------------

MAX_HOT = 1 << 20           # hot nodes of a table at most: its threshold rises until that holds
HARMLESS = 8                # tables of so many thresholds have no need to look for hot nodes

#: What the rows (a, b) of a round's table are, a folder ``kind=...`` for each: edges of
#: the next graph (once, a < b), tree rows (child, parent), seed candidates.
EDGE, TREE, CANDIDATE = 0, 1, 2


@dataclass
class ContractionResult:
    """Propagation forest, its seeds, and per-round statistics."""

    resolved: DataFrame            # (node, parent, round); parent == node for seeds
    rounds: int
    graph_log: list[dict] = field(default_factory=list)
    workspace: Workspace | None = None
    _log: list[dict] | None = None

    @property
    def tree(self) -> DataFrame:
        return (self.resolved.where(F.col("parent") != F.col("node"))
                    .select("parent", F.col("node").alias("child"), "round"))

    @property
    def seeds(self) -> DataFrame:
        return (self.resolved.where(F.col("parent") == F.col("node"))
                    .select("node", "round"))

    @property
    def tree_rows(self) -> int:
        return sum(r["tree_rows"] for r in self.graph_log)

    @property
    def log(self) -> list[dict]:
        """Per round: graph rows at the start, tree rows and seeds it produced. The
        seeds are counted the first time the log is asked for."""
        if self._log is None:
            seeds = {r["round"]: r["s"] for r in
                     self.seeds.groupBy("round").agg(F.count(F.lit(1)).alias("s")).collect()}
            self._log = [{**g, "seeds": seeds.get(g["round"], 0)} for g in self.graph_log]
        return self._log

    def log_frame(self) -> DataFrame:
        """One row per round — graph rows at the start, tree rows, seeds."""
        spark = self.resolved.sparkSession
        rows = [(r["round"], r["edges"], r["tree_rows"], r["seeds"]) for r in self.log]
        return spark.createDataFrame(
            rows, "round INT, edges BIGINT, tree_rows BIGINT, seeds BIGINT")


@dataclass
class _Graph:
    """The graph of a round: rows (a, b[, active]), and its hot nodes (a), if any."""

    rows: int
    edges: DataFrame
    hot: DataFrame | None = None


class _Rounds:
    """The steps of the loop, for one run."""

    def __init__(self, ws: Workspace, strategy: str, activity: bool, hot_threshold: int):
        self.ws, self.strategy, self.activity, self.threshold = ws, strategy, activity, hot_threshold
        self.act = ["active"] if activity else []
        self.used: list[DataFrame] = []         # tables that the round alone needs
        self.schema = "a BIGINT, b BIGINT, round INT" + (", active BOOLEAN" if activity else "")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        self.used.append(self.ws.save(df, name))
        return self.used[-1]

    def _agg(self) -> list:
        return [F.expr("bool_and(active) AS active")] if self.activity else []

    def first(self, edges: DataFrame, once: bool = False) -> dict:
        """Writes the graph; with ``once``, ``edges`` has each edge once."""
        turned = F.count(F.when(F.col("a") != F.col("b"), 1)) if once else F.lit(0)
        g = self.ws.save(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *self.act), "graph",
                         {"rows": F.count(F.lit(1)) + turned})
        return {"round": 0, "path": g._linkset_path, "rows": g.metrics["rows"], "activity": self.activity,
                "once": once}

    def opened(self, record: dict) -> _Graph:
        """The graph that a commit record speaks of."""
        path, schema = record["path"], self.schema
        if record["round"] == 0:
            rows, schema = record["rows"], schema.replace(", round INT", "")
        else:
            rows, path = record["counts"]["edges"], f"{path}/kind={EDGE}"
        if not rows:
            return _Graph(0, self.ws.spark.createDataFrame([], schema))
        edges = self.ws.spark.read.schema(schema).parquet(path).select("a", "b", *self.act)
        if record.get("once"):
            edges = both_ways(edges, "a", "b", *self.act)
        edges = self.ws.adopt(edges, path)
        limit = max(self.threshold, rows // MAX_HOT)
        if rows <= HARMLESS * limit:
            return _Graph(rows, edges)
        hot = over_threshold(edges, "a", limit, self.ws)
        if hot is not None:
            self.used.append(hot)
        return _Graph(rows, edges, hot)

    # -- H, as a bag (node, w, sender[, active]) --

    def sent_cold(self, edges: DataFrame) -> DataFrame:
        """Every node's minimum, to its neighbours and itself: the row of its
        smallest neighbour, one for each node, also stands for the node."""
        flag = ["bool_and(active) OVER (PARTITION BY a) AS active"] if self.activity else []
        seen = edges.selectExpr("a", "b", "min(b) OVER (PARTITION BY a) AS mn", *flag)
        return seen.selectExpr("explode(if(b = mn, array(b, a), array(b))) AS node", "least(a, mn) AS w",
                               "a AS sender", *self.act)

    def sent_hot(self, edges: DataFrame) -> DataFrame:
        m = self._kept(edges.groupBy("a").agg(F.expr("least(a, min(b)) AS w"), *self._agg()), "hot-minima")
        sent = edges.select("a", "b").join(F.broadcast(m), "a")
        return sent.selectExpr("b AS node", "w", "a AS sender", *self.act).unionByName(
            m.selectExpr("a AS node", "w", "a AS sender", *self.act))

    # -- G', tree rows and candidates, as rows (kind, a, b[, active]) --

    def _emitted(self) -> list[str]:
        """What a row of H leads to: the edge vm - w, or if it holds the minimum its
        node's tree row or candidacy; a row without a kind is none. A node's equal rows
        lead to equal ones, which are left out with those of other nodes."""
        return [f"CASE WHEN w <> vm THEN {EDGE} WHEN NOT self THEN {TREE} WHEN vm = mx THEN {CANDIDATE} END AS kind",
                "if(w <> vm, vm, node) AS a", "if(w <> vm, w, if(self, node, vm)) AS b", *self.act]

    def next_cold(self, h: DataFrame) -> DataFrame:
        # without an order in the windows, rows are sorted by one column
        flag = ["bool_and(active) OVER (PARTITION BY node) AS active"] if self.activity else []
        seen = h.selectExpr("node", "w", "min(w) OVER (PARTITION BY node) AS vm", "max(w) OVER (PARTITION BY node) AS mx",
                            "bool_or(w = node) OVER (PARTITION BY node) AS self", *flag)
        return seen.selectExpr(*self._emitted()).where("kind IS NOT NULL")

    def next_hot(self, h: DataFrame) -> DataFrame:
        q = self._kept(h.groupBy("node").agg(F.expr("min(w) AS vm"), F.expr("max(w) AS mx"),
                                             F.expr("bool_or(w = node) AS self"), *self._agg()), "hot-nodes")
        seen = h.select("node", "w").join(F.broadcast(q), "node")
        return seen.selectExpr(*self._emitted()).where("kind IS NOT NULL")

    def _split(self, g: _Graph) -> DataFrame:
        """A round with hot nodes: H is written, for it is read twice."""
        hot = F.broadcast(g.hot)
        sent = self.sent_cold(g.edges.join(hot, "a", "left_anti")).unionByName(
            self.sent_hot(g.edges.join(hot, "a", "left_semi")))
        is_hot = F.broadcast(g.hot.select(F.col("a").alias("node"), F.lit(True).alias("hot")))
        h = self._kept(sent.drop("sender").join(is_hot, "node", "left"), "sent")
        return self.next_cold(h.where("hot IS NULL").drop("hot")).unionByName(
            self.next_hot(h.where("hot").drop("hot")))

    def _joined(self, g: _Graph) -> DataFrame:
        """A round by joins of per-node tables, under the caller's strategy."""
        edges = g.edges.withColumnsRenamed({"a": "src", "b": "dst"})
        hot_rows = 0 if g.hot is None else None
        m = self._kept(local_minima(edges, self.activity), "minima")
        h = self._kept(_sent(edges, m, self.strategy, self.activity, self.threshold, hot_rows), "sent")
        q = self._kept(summarize(h, self.activity), "nodes")
        nxt = pruned_once(h, q, self.strategy, self.activity, self.threshold + 1, hot_rows)
        return (nxt.selectExpr(f"{EDGE} AS kind", "src AS a", "dst AS b", *self.act)
                .unionByName(q.where("NOT self").selectExpr(f"{TREE} AS kind", "node AS a", "vm AS b", *self.act))
                .unionByName(q.where("single AND self").selectExpr(
                    f"{CANDIDATE} AS kind", "node AS a", "node AS b", *self.act)))

    def rows(self, g: _Graph) -> DataFrame:
        """All that a round makes of its graph, as a set."""
        if self.strategy != "auto":
            return self._joined(g)
        made = self.next_cold(self.sent_cold(g.edges)) if g.hot is None else self._split(g)
        keys = ["kind", "a", "b"]
        return made.groupBy(*keys).agg(*self._agg()) if self.activity else made.dropDuplicates(keys)

    def step(self, g: _Graph, r: int) -> dict:
        """Writes the round's table; returns its commit record."""
        with dealt(self.ws.spark, g.rows):
            out = self.rows(g).select("a", "b", F.lit(r).cast("int").alias("round"), *self.act, "kind")
            made = self.ws.save(out, f"round-{r}", {
                name: F.count(F.when(F.col("kind") == kind, 1))
                for name, kind in (("edges", EDGE), ("tree", TREE), ("candidates", CANDIDATE))}, by="kind")
        # G' has no self-loop: as a symmetric table, it has two rows for each edge
        counts = {**made.metrics, "edges": 2 * made.metrics["edges"]}
        return {"round": r, "path": made._linkset_path, "counts": counts, "from": g.rows, "once": True}

    def done(self, g: _Graph) -> None:
        """The round is committed: what it was made from can go."""
        self.ws.release(g.edges, *self.used)
        self.used = []


def _seeds(rounds: _Rounds, records: list[dict], tree: DataFrame | None, strategy: str) -> DataFrame | None:
    """(node, round): candidates that never retire, in the last round that has them
    (a candidate that stays in the graph is a candidate or a child again later)."""
    paths = [f"{r['path']}/kind={CANDIDATE}" for r in records if r["counts"]["candidates"]]
    if not paths:
        return None
    found = rounds.ws.spark.read.schema(rounds.schema).parquet(*paths)
    last = [F.max("round").alias("round"), *([F.max_by("active", "round").alias("active")] if rounds.activity else [])]
    found = found.groupBy(F.col("a").alias("node")).agg(*last)
    if rounds.activity:
        found = found.where("active")
    if tree is not None:
        found = join_keyed(found, tree.select("node"), "node", "left_anti", strategy)
    return found.select("node", "round")


def contract(edges: DataFrame, *, normalized: bool = False, prune_strategy: str = "auto",
             seed_strategy: str = "auto", activity: bool = False,
             hot_threshold: int | None = None, workspace: Workspace | None = None,
             resume: str | None = None) -> ContractionResult:
    """Run rounds until the graph is empty.

    ``edges`` is any ``(src, dst)`` table; it is normalised (G1+G3, S8) unless
    ``normalized``, and written once. With ``activity``, a node that starts
    with a False flag makes no seed of a component it is part of: flags are
    combined with AND along every edge row.

    A round is one job: it reads the graph and writes one table with the next graph,
    the round's tree rows and its seed candidates. The numbers that end the
    loop and fill the log are taken by that write. Seeds are the candidates that
    never retire; they are found once, at the end. Only scalars reach the
    driver; an unreadable file is an error, never an empty graph.

    ``resume`` names a folder for this run alone. Each finished round leaves a
    commit record there. If the driver is lost, the same call goes on after
    the last of them; once all is done it returns the result as it is.
    """
    spark = edges.sparkSession
    ws = Workspace.at(spark, resume) if resume else workspace or Workspace(spark, label="contract")
    rounds = _Rounds(ws, prune_strategy, activity, HOT_KEY_ROWS if hot_threshold is None else hot_threshold)
    records = ws.commits() if resume else []
    if not records:
        e = edges if normalized else undirected(edges)
        if activity and "active" not in e.columns:
            e = e.withColumn("active", F.lit(True))
        records.append(rounds.first(e, once=not normalized))
        if resume:
            ws.commit(0, records[0])
    elif records[0]["activity"] != activity:
        raise ValueError(f"the run in {resume} was begun with activity={records[0]['activity']}")
    while "result" not in records[-1]:
        g = rounds.opened(records[-1])
        if not g.rows:
            break
        r = len(records)
        records.append(rounds.step(g, r))
        if resume:
            ws.commit(r, records[-1])
        rounds.done(g)
    done = [r for r in records[1:] if "result" not in r]
    if not done:
        return ContractionResult(spark.createDataFrame([], "node BIGINT, parent BIGINT, round INT"), 0, [], ws)
    paths = [f"{r['path']}/kind={TREE}" for r in done if r["counts"]["tree"]]
    tree = (spark.read.schema(rounds.schema).parquet(*paths).selectExpr("a AS node", "b AS parent", "round")
            if paths else None)
    if "result" in records[-1]:
        seeds = spark.read.schema("node BIGINT, round INT").parquet(records[-1]["result"])
    else:
        with dealt(spark, sum(r["counts"]["tree"] + r["counts"]["candidates"] for r in done)):
            found = _seeds(rounds, done, tree, seed_strategy)
            if found is None:
                found = spark.createDataFrame([], "node BIGINT, round INT")
            seeds = ws.save(found, "seeds")
        if resume:
            ws.commit(len(records), {"result": seeds._linkset_path})
    resolved = seeds.selectExpr("node", "node AS parent", "round")
    if tree is not None:
        resolved = tree.unionByName(resolved)
    log = [{"round": r["round"], "edges": r["from"], "tree_rows": r["counts"]["tree"]} for r in done]
    return ContractionResult(resolved, len(done), log, ws)


# -- views over the forest ------------------------------------------------------

def tree_children(tree: DataFrame, per_row: int = LIST_ROWS) -> DataFrame:
    """``(parent, block, children ARRAY<LONG>)``, children ascending; a seed
    with more than ``per_row`` children has a row for each ``per_row`` of them."""
    return (id_lists(tree.select("parent", "child"), "parent", "child", per_row, distinct=True)
            .withColumnRenamed("ids", "children"))


def component_count(seeds: DataFrame) -> DataFrame:
    """C11: number of components as a one-row table."""
    return seeds.agg(F.count(F.lit(1)).cast("long").alias("components"))
