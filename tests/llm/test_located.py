"""op7 names the offending sentences."""

import random

from skein.llm import toxicity


def test_op7_locates_sentences(spark, documents, tmp_path):
    draw, rows = random.Random(3), []
    for k in range(300):
        parts = [" ".join(draw.choice(["sun", "sea", "tree", "road", "bird"]) for _ in range(6)) for _ in range(3)]
        if k % 3 == 0:
            parts[1] += " vile scum"
        rows.append((k, ". ".join(parts)))
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.op7_toxicity(spark, str(tmp_path)).collect()}
    for k, text in rows:
        cut = [text[s.start : s.end] for s in out[k].tox_sentences]
        assert cut == [s for s in text.split(".") if "scum" in s] and out[k].predicted == int(k % 3 == 0)
