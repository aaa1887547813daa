"""Surrogates beside input columns that have the name of the new one."""

import pytest

from quillspark.llm import pii_surrogates as P


@pytest.mark.parametrize("names, new", [(["entities"], "entities_found"), (["Entities", "entities_found"], "entities_found_"),
                                        (["other"], "entities")])
def test_input_columns_of_that_name_stay(spark, names, new):
    docs = spark.createDataFrame([(1, "write to ann@example.org", *("x" for _ in names)), (2, None, *("y" for _ in names))],
                                 ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    out = P.replace_entities(docs)
    assert out.columns == [*docs.columns, new]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[1][n] == "x" and got[2][n] == "y" for n in names)
    assert [e.kind for e in got[1][new]] == ["email"] and got[2][new] == []
    assert "ann@" not in got[1].text and got[2].text is None
