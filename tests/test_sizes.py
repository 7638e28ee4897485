"""Registered keys run at the reference sizes."""

import __spark_entry__
from tests.conftest import SF


def test_als_item_vectors_have_reference_size(spark):
    vectors = __spark_entry__.queries()["als_item_vectors"](spark, SF).select("vec").collect()
    assert vectors and all(len(r.vec) == 64 for r in vectors)
