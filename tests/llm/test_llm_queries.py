import pytest
from harness import compare, connect

from firnline.llm import queries as llm

ROWS = {"op2_topk_search": None, "pipeline": None, "op1_best_fit_packing": None, "op7_html_text": "pages", "op11_hard_negatives": None}


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    r = compare(spark, connect(sf_dir), name, llm.queries()[name], llm.oracle_sql()[name], sf_dir)
    assert r["ok"], r["why"]


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_runs_over_the_whole_table(spark, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    n, given = df.count(), ROWS.get(name, "documents")
    assert n == spark.read.parquet(f"{sf_dir}/{given}.parquet").count() if given else n > 0


def test_each_operator_has_one_query():
    names = list(llm.queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 14)] and names[-1] == "pipeline"
