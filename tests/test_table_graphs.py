"""Round-by-round counts on the graphs over the driver tables (FIXTURES §4, sf0.01)."""

import os

import pytest

from linkset.operators.contract import contract
from linkset.operators.stars import star_components
from linkset.plans import testgraphs as TG

SF = "/root/testdata/sf0.01"

# graph: (tree rows by round, seeds by round, graph rows at the start of each round or None)
EXPECTED = {
    "order_part": ([14187, 2479, 76], [0, 0, 1], [119890, 134130, 290]),
    "part_supp": ([2065, 34], [0, 1], [103462, 134]),
    "order_chain": ([1498, 2974, 5325, 3611, 92], [4, 43, 453, 956, 42],
                    [27000, 45020, 52532, 14734, 192]),
    "cust_nation": ([1485, 15], [14, 11], None),
}
STAR_ROUNDS = {"order_part": 5, "part_supp": 3, "order_chain": 6}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("graph", sorted(EXPECTED))
def test_round_counts(spark, graph):
    tree_rows, seeds, edges = EXPECTED[graph]
    res = contract(TG.GRAPHS[graph](spark, SF), hot_threshold=None if graph == "order_chain" else 64)
    assert res.rounds == len(tree_rows)
    assert [r["tree_rows"] for r in res.log] == tree_rows
    assert [r["seeds"] for r in res.log] == seeds
    if edges is not None:
        assert [r["edges"] for r in res.log] == edges


@pytest.mark.parametrize("graph", sorted(STAR_ROUNDS))
def test_star_rounds(spark, graph):
    assert star_components(TG.GRAPHS[graph](spark, SF)).rounds == STAR_ROUNDS[graph]
