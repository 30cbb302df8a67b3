import os

import pytest

from helixframe.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p2_found": ["seq_id_a", "seq_id_b"], "p3_found": ["seq_id", "piece_no", "start_pos", "end_pos"], "p4_found": ["word", "mark"], "p5_found": ["seq_id", "start_pos", "end_pos"],
    "p6_found": ["first_id", "copy_id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_with_its_columns(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
