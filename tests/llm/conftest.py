import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and a to in is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("copies", T.LongType()), T.StructField("size", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("row", T.LongType())])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", "ed"]) for _ in range(n))


def make_rows() -> list[tuple]:
    rng = random.Random(3)
    base = [prose(rng, rng.randint(20, 400)) for _ in range(60)]
    passage = prose(rng, 60)
    texts = list(base)
    texts += [base[i] for i in (1, 1, 1, 2, 5, 5)]  # exact copies
    for i in range(10, 30):  # near copies
        words = base[i].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [t + "\n" + passage + "\n" + prose(rng, 30) for t in base[30:40]]
    texts += [None, "", "", " \n ", "One.", "ONE.", "one two", "é ü 日本語 test", "ab " * 300, "mail a.b@c.example.com or +1 (555) 123-4567, 10.0.0.255 and 4111 1111 1111 1111", "1 " * 200]
    texts.append(prose(rng, 12_000))  # a very long one
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), len(t or ""), "h", 7, 8, "s", 9))
    rows.append(rows[3])  # a repeated row
    rows.append((3, "another text under a used number " * 10, None, "b", 1, "h", 7, 8, "s", 9))
    rows.append((None, "a text without a number " * 12, "en", None, 1, "h", 7, 8, "s", 9))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
