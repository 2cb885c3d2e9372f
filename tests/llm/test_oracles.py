"""The registered queries against their SQL."""

import pytest
from compare import connect, differences

from siftwell.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert not differences(queries.queries()[name](spark, SF), connect(SF).sql(queries.oracle_sql()[name]))


def test_all_eleven_run(spark):
    assert len(queries.queries()) == 10
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "embeddings", "pages")}
    for name, table in {"op2_mixing": "documents", "op5_secrets": "documents", "op6_toxicity": "documents", "op8_lm": "documents", "op9_simhash": "documents"}.items():
        assert queries.queries()[name](spark, SF).count() == rows[table]
    assert 0 < queries.queries()["op1_resampling"](spark, SF).count() < rows["documents"]
