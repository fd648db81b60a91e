"""Connected components of large undirected graphs on Spark DataFrames."""

from linkset.operators.contract import ContractionResult, contract
from linkset.operators.merge import merge_components
from linkset.operators.propagate import propagate_jump, propagate_layers, root_of
from linkset.operators.stars import star_components
from linkset.plans.solve import connected_components, connected_components_named
from linkset.sources.edges import read_edges, read_edges_whitespace, read_string_edges

__all__ = [
    "ContractionResult", "connected_components", "connected_components_named", "contract",
    "merge_components",
    "propagate_jump", "propagate_layers", "read_edges", "read_edges_whitespace",
    "read_string_edges", "root_of", "star_components",
]
