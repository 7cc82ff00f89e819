import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_found_queries_have_the_columns_asked_for(spark):
    from framequilt.llm.queries import QUERIES, SQL

    want = {"p1_found": ["youtube_id", "group_id"], "p2_found": ["origin", "record_id"], "p4_found": ["row_id_a", "row_id_b"], "p6_found": ["field", "category"], "p7_found": ["stage", "doc_id"], "p8_found": ["source"]}
    for name, columns in want.items():
        df = QUERIES[name](spark, DATA)
        assert df.columns == columns, name
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == len(set(rows)), name
    assert set(SQL) <= set(QUERIES)


def test_nothing_outside_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "framequilt")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as s:
                        assert "framequilt.llm" not in s.read(), f
