"""The training findings of the secret scan are planned from written texts."""

from docengine.llm.secret_scan import candidates, example_findings, example_texts


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_findings_plan_does_not_repeat_the_making_of_texts(spark):
    texts = example_texts(spark, 240)
    found = example_findings(spark, 240)
    assert "xxhash64" in planned(texts) and "xxhash64" not in planned(found)
    made = candidates(texts).join(texts.select("doc_id", "secret"), "doc_id").select("candidate", "before", "after", "secret")
    assert len(planned(found)) < len(planned(made)) / 3
    assert sorted(found.collect()) == sorted(made.collect()) != []
