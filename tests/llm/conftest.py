import pytest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents, with awkward rows: nulls, empty, repeated, long, and clashing extra columns."""
    base = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(f"w{k % 977} x{k % 1009}" for k in range(30_000))
    odd = [
        (1_000_000, None, None, None, None), (1_000_001, "", "en", None, 0), (1_000_002, " \t\n", "en", "src0", 3), (1_000_003, "one", "en", "src0", 3),
        (1_000_004, long, "en", "srcz", len(long)), (1_000_005, "same text here twice over", "en", "src1", 1), (1_000_005, "same text here twice over", "en", "src1", 1),
        (None, "a null id with some words", "en", "src1", 1), (1_000_006, "É\x00 \x1c a b  c\r\n\n\nd<|endoftext|> 'tis", "fr", "src2", 5),
    ]
    return base.unionByName(spark.createDataFrame(odd, base.schema)).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    names = "place shard slot block fingerprint fp root stats n_words kept score text_hash stay_id mix_source mix_nth part ids text_bytes".split()
    return docs.select("*", *(F.lit(1).alias(c) for c in names))


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.collect()]
