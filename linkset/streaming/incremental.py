"""Components kept current over a stream of edge batches (M1 per micro-batch).

:func:`merge_batch` is a plain function from a table and a batch to the next
table. Where the table is stored, and how a version becomes current, is the
job's choice: call it inside ``foreachBatch`` and write the result with a
format that overwrites atomically, or into a folder named by the batch id, so
that a replayed batch writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkset.operators.merge import merge_components


def merge_batch(components: DataFrame, batch: DataFrame, **kw) -> DataFrame:
    """``(node, component)`` after the edges ``(src, dst)`` of a batch. Merging a
    batch twice changes nothing, so a replay is safe."""
    return merge_components(components, extra_edges=batch, **kw)
