"""drop_near where identifiers are null or repeated."""

from skein.llm import simhash

NEAR = "one two three four five six seven"


def test_drop_near_tells_rows_apart_without_identifiers(documents):
    rows = [(1, NEAR), (None, NEAR.upper()), (None, "a clean text that nothing else is like"), (None, "some other words"), (None, "some  other words"), (7, NEAR), (7, "the clean text under a repeated identifier"), (8, "twice"), (8, "twice")]
    kept = sorted((repr(r.doc_id), r.text.split()[0]) for r in simhash.drop_near(documents(rows).repartition(3)).collect())
    assert kept == sorted([("1", "one"), ("None", "a"), ("None", "some"), ("7", "the"), ("8", "twice")])
