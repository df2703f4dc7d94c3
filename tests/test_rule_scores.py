from __future__ import annotations

from emberlog import queries
from emberlog.operators import rules
from emberlog.sources import lines as source


def test_rule_scores_judge_the_whole_sample(spark, tmp_path):
    text = lambda d, n: "\n".join("2024-01-02 03:04:05 ERROR [main] disk full" if 10 <= k < n - 10 and k % 2 else f"plain {d} words" for k in range(n))
    spark.createDataFrame([(1, text(1, 100)), (2, text(2, 60))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # both texts are shorter than the sample: all their lines count
    whole = rules.scores(queries.document_lines(spark, str(tmp_path)))
    show = lambda df: sorted(map(repr, df.collect()))
    assert show(queries.rule_scores(spark, str(tmp_path))) == show(whole)
    assert show(whole) != show(rules.scores(source.sample(queries.document_lines(spark, str(tmp_path)), 6)))
