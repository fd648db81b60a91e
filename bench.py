"""Benchmark the headline graph queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: total seconds over the headline queries, each query's
seconds, and the scale. Every query runs from the parquet tables to a fully
computed result (a ``noop`` write forces every row); what a step needs from an
earlier one (a contraction, the parts of a merge) is made before its clock
starts. A warm-up on the next smaller tables runs first so JVM start-up is not
counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from linkset.operators.contract import contract  # noqa: E402
from linkset.operators.ids import dense_ids, node_names  # noqa: E402
from linkset.operators.merge import merge_components  # noqa: E402
from linkset.operators.propagate import propagate_jump, propagate_layers  # noqa: E402
from linkset.operators.stars import star_components  # noqa: E402
from linkset.plans import catalog  # noqa: E402
from linkset.plans import testgraphs as TG  # noqa: E402
from linkset.plans.session import build_session  # noqa: E402
from linkset.plans.solve import connected_components  # noqa: E402


def _run(df) -> None:
    df.write.mode("overwrite").format("noop").save()


def _half(spark, sf, early: bool):
    li = TG.table(spark, sf, "lineitem")
    cond = F.year("l_shipdate") < 1998
    return (li.where(cond if early else ~cond)
            .select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
            .distinct())


def headline(spark, sf: str) -> dict:
    """Name -> function that prepares and returns the timed step."""
    def cc(graph, **kw):
        return lambda: lambda: _run(connected_components(TG.GRAPHS[graph](spark, sf), **kw))

    def contraction_only(graph):
        return lambda: lambda: _run(contract(TG.GRAPHS[graph](spark, sf)).resolved)

    def chain_propagation(kind):
        def prepare():
            res = contract(TG.order_chain(spark, sf))
            if kind == "jump":
                return lambda: _run(propagate_jump(res.tree, res.seeds))
            rounds = res.rounds if kind == "rounds" else None
            return lambda: _run(propagate_layers(res.tree, res.seeds, rounds=rounds))
        return prepare

    def merge():
        a, b = (connected_components(_half(spark, sf, early)) for early in (True, False))
        return lambda: _run(merge_components(a, b))

    strategies = {f"cc_part_supp_{p}_{s}": cc("part_supp", prune_strategy=p, seed_strategy=s)
                  for p in ("broadcast", "shuffle") for s in ("broadcast", "shuffle")}
    return {
        "cc_order_part": cc("order_part"),
        "cc_part_supp": cc("part_supp"),
        "cc_part_supp_hubs": cc("part_supp", hot_threshold=catalog.HUB_THRESHOLD),
        **strategies,
        "cc_order_chain": cc("order_chain"),
        "contract_order_chain": contraction_only("order_chain"),
        "prop_rounds_order_chain": chain_propagation("rounds"),
        "prop_layers_order_chain": chain_propagation("layers"),
        "prop_jump_order_chain": chain_propagation("jump"),
        "cc_stars_order_part": lambda: lambda: _run(
            star_components(TG.order_part(spark, sf)).components),
        "dense_ids_cust_nation": lambda: lambda: _run(
            dense_ids(node_names(TG.cust_nation_names(spark, sf)))),
        "merge_step_order_part": merge,
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          extra={"spark.ui.showConsoleProgress": "false"})
    # JVM warm-up on a smaller table set (not timed): the same plans at a
    # different scale, so JIT and codegen caches are warm as in a long session
    base = os.path.dirname(sf.rstrip("/"))
    warm = next((d for d in (os.path.join(base, n) for n in ("sf0.01", "sf0.001"))
                 if os.path.isdir(d) and os.path.abspath(d) != os.path.abspath(sf)), None)
    if warm is not None:
        for graph in ("order_part", "order_chain"):
            _run(connected_components(TG.GRAPHS[graph](spark, warm)))
        _run(star_components(TG.order_part(spark, warm)).components)
    times = {}
    for name, prepare in headline(spark, sf).items():
        step = prepare()
        t0 = time.time()
        step()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "graph_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
