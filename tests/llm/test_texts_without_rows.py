import os

import pytest

from quireflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("nulls", [False, True])
def test_empty_tables_and_nulls(spark, tmp_path, nulls):
    """Tables without rows give no rows; rows that are null throughout give none either, but for the ids of texts."""
    for t in "form_fields signatures bookmarks words chars documents mix_targets".split():
        d = spark.read.parquet(f"{SF}/{t}.parquet")
        spark.createDataFrame([(None,) * len(d.columns)] if nulls else [], d.schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if nulls and name in ("p6_ids", "p7_shares") else 0), name
