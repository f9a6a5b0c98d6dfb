"""Columns of the input that bear the operators' own names, or odd ones, stay as they are."""

import corpus_pipeline
from skein.llm import decontaminate, exact_dedup, simhash

from .conftest import ITEM


def test_filters_keep_columns_whatever_their_names(spark, clashing):
    bench = spark.createDataFrame([(1, "six")], ITEM)
    for out, left in ((exact_dedup.drop_exact(clashing), [2, 3, 4]), (simhash.drop_near(clashing), [1, 3, 4]), (decontaminate.drop_contaminated(clashing, bench), [1, 2, 4]), (decontaminate.remove_spans(clashing, bench), [1, 2, 4])):
        assert out.columns == clashing.columns and sorted(r.doc_id for r in out.collect()) == left


def test_exact_stage_with_repeated_rows(spark, documents):
    rows = [(2, "a"), (2, "a"), (2, "A"), (1, "a"), (3, "b"), (3, "c")] + [(None, "d")] * 2
    out = corpus_pipeline.exact_filter(spark, documents(rows), "")
    assert sorted((repr(r.doc_id), r.text.lower()) for r in out.collect()) == [("2", "a"), ("3", "b"), ("3", "c"), ("None", "d")]
