"""Fixed table shapes used by every operator.

All node ids are LONG: ids come from 64-bit key columns, and text edge files may
carry ids beyond the 32-bit range.
"""

from pyspark.sql import types as T

EDGES = T.StructType([
    T.StructField("src", T.LongType(), False),
    T.StructField("dst", T.LongType(), False),
])

# Edge text: the two id fields; a missing second field marks an isolated vertex.
EDGE_TEXT = T.StructType([
    T.StructField("src", T.LongType(), True),
    T.StructField("dst", T.LongType(), True),
])

COMPONENTS = T.StructType([
    T.StructField("node", T.LongType(), False),
    T.StructField("component", T.LongType(), False),
])
