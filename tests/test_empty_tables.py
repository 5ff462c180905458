import os

import pytest

from quireflow.operators import instants, nested

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("nulls", [False, True])
def test_no_rows(spark, tmp_path, nulls):
    for t in "signatures certificates places outlines".split():
        d = spark.read.parquet(f"{SF}/{t}.parquet")
        spark.createDataFrame([(None,) * len(d.columns)] if nulls else [], d.schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for query in (instants.p3_found, instants.p3_readings, nested.p4_found, nested.p4_tables):
        assert query(spark, str(tmp_path)).count() == 0
