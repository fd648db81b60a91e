import uuid

import pytest

from linkset.plans.workspace import Workspace

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def ws(spark):
    w = Workspace(spark, label=f"test-{uuid.uuid4().hex[:6]}")
    yield w
    w.close()


@pytest.fixture
def docs(spark):
    """Makes a documents table, with extra columns under clashing names."""
    def make(rows, extra=True):
        full = [(i, t, *rest, *([None] * (3 - len(rest)))) for i, t, *rest in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            for name in ("key", "size", "n", "k", "fp", "h", "length", "bucket", "component", "spans"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make
