import pytest
from chartula.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", [n for n in QUERIES if n.endswith("_found")])
def test_columns(spark, sf, name):
    want = {
        "p1_found": "chunk_id string, line_no bigint", "p2_found": "chunk_id string, cut_kind string", "p3_found": "term string, term_mark string", "p4_found": "chunk_a string, chunk_b string",
        "p5_found": "id string, source_run string, defect string", "p6_found": "doc_id bigint", "p7_found": "doc_id bigint, id string", "p8_found": "doc_id bigint, reading_level bigint",
    }[name]
    df = QUERIES[name](spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == want
    assert df.count() == df.distinct().count() and set(ORACLES) <= set(QUERIES)
