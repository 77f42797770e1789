import importlib
import sys

import duckdb
import pytest

import __spark_entry__


def test_names_and_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80 and len(sql) > 60


def test_imports_without_the_text_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "quillgraph.llm", None)
    for name in [n for n in sys.modules if n.startswith("quillgraph.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    made = importlib.reload(__spark_entry__)
    assert not any(n.startswith("op") and n[2].isdigit() for n in made.queries()) and "pipeline" not in made.oracle_sql()


@pytest.mark.parametrize("name", ["bm25_topk", "edge_score_ctor", "greedy_pack", "retrieval_mrr", "sft_token_stats", "canonical_prefix", "call_lines", "receiver_types", "agent_reads", "definition_pick", "rendered_candidates"])
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("benchmark", "conversations", "documents", "embeddings", "events", "lineitem", "orders", "part", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    made = __spark_entry__.queries()[name](spark, small)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(made.columns)
    assert columns == sorted(want.columns)
    norm = lambda rows: sorted(tuple("" if v is None else round(float(v), 6) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
    assert norm(made.select(*columns).collect()) == norm(want.select(*columns).fetchall())


def test_entry(spark):
    assert {"case_id", "k", "recall"} <= set(__spark_entry__.entry(spark).columns)
