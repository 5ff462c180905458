import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql_gives_the_same(spark):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    norm = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    queries = entry.queries()
    for name, sql in entry.oracle_sql().items():
        df = queries[name](spark, SF)
        cols = sorted(df.columns)
        ours = sorted(repr(tuple(norm(x) for x in r)) for r in df.select(cols).collect())
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == cols, name
        theirs = sorted(repr(tuple(norm(row[names.index(k)]) for k in cols)) for row in r.fetchall())
        assert ours == theirs, name


def test_core_without_text_operators():
    for folder, _, files in os.walk(os.path.join(os.path.dirname(entry.__file__), "quireflow")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"\bllm\b", open(os.path.join(folder, f)).read()), f
