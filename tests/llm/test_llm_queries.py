import pytest
from compare import rows_of, rows_of_sql, views

from corpusmill.llm.queries import queries
from corpusmill.llm.sql import oracle_sql

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    path = small.replace("0.001", "0.01")
    assert rows_of(queries()[name](spark, path)) == rows_of_sql(views(path), SQL[name])


COLUMNS = {
    "p2_found": [("trace_id", "bigint"), ("defect", "string")],
    "p3_found": [("puzzle_id", "string"), ("field_name", "string"), ("trace_id", "bigint")],
    "p4_found": [("task_type", "string"), ("row_index", "bigint")],
    "p5_found": [("rec_table", "string"), ("rec_key", "bigint")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id", "bigint"), ("para_no", "int"), ("true_lang", "string")],
}


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_runs(spark, small, name):
    d = queries()[name](spark, small)
    assert d.count() > 0 and d.dtypes == COLUMNS.get(name, d.dtypes)


def test_core_stands_alone():
    import os
    import re

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "corpusmill")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as src:
                    assert not re.search(r"corpusmill\.llm|from \.+llm", src.read()), f
