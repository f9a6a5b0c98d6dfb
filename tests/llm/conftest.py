import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
#: Words that no test expects to match others.
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
#: Null, empty and very long texts, ties, repeated rows, null identifiers, other scripts, control characters.
TRICKY = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "A"), (5, "A"), (6, LONG), (7, LONG.upper()), (8, "Été, naïve—ÇA? ΑΣ İ 日本語 😀 \x1c\x85 x"), (9, "́  '"), (None, "alone"), (None, None), (10, "don't  stop\r\n\r\nnow 123 12:30"),
    (11, "<|endoftext|> and <|startoftext|>x"), (12, "\x00\\ ### </turn>"), (13, "x" * 5000),
]


@pytest.fixture(scope="session")
def documents(spark):
    """make(rows of (doc_id, text)) gives a documents table."""
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


@pytest.fixture(scope="session")
def tricky(documents):
    return documents(TRICKY).repartition(3)


#: Names that operators use themselves, inside or for what they give, and odd ones.
NAMES = """_text _key _sha _run _digest _bytes _check fp _doc _lang _toxic _size _held _salt _one kept score lang_pred lang_score word_langs tox_score
tox_sentences _gone _gone_key _gone_sha _other_key _other_sha _row _row_ _spans _c _mean _rejected base added root row keep found a b doc hash""".split() + ["a `tick`", "a space", "a.dot"]


@pytest.fixture(scope="session")
def clashing(documents):
    """Extra columns under names that operators might use themselves, one of them a struct with an odd field."""
    from pyspark.sql import functions as F

    df = documents([(1, "one two three four five"), (2, "ONE two three four five"), (3, "six"), (4, "idiot trash")])
    return df.select("*", *[F.lit(0).alias(name) for name in NAMES], F.struct(F.lit(1).alias("a field")).alias("nested"))
