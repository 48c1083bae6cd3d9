"""The pipeline on a small table: every stage's decisions take effect and columns last."""

import corpus_pipeline
from labelweave.llm import line_quality, nb_linear, order_join, phrase_index
from labelweave.llm.queries import QUERIES
from labelweave.llm.shared import stored, table


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark, sf_dir):
    docs = stored(table(spark, sf_dir, "documents"), "documents")
    columns = docs.columns
    ids = lambda df, column="doc_id": {r[0] for r in df.select(column).collect()}
    wanted = {
        "quality rules": lambda d: ids(line_quality.score_lines(d).filter("kept")),
        "toxicity": lambda d: ids(nb_linear.score_toxicity(d, table(spark, sf_dir, "labels")).filter("predicted = 0")),
        "n-gram Jaccard join": lambda d: ids(order_join.linked(d), "component_id"),
        "benchmark decontamination": lambda d: ids(
            phrase_index.contamination(d, table(spark, sf_dir, "benchmark")).filter("not contaminated")
        ),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir), "stage")
        assert out.columns == columns
        assert ids(out) <= ids(docs) and out.count() > 0
        if name in wanted:
            assert ids(out) == wanted[name](docs)
        docs = out
