import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeats, a long text, and columns that carry names the operators use inside."""
    prose = "The quick brown fox jumps over the lazy dog and runs along the river to the old mill by the sea. "
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "word", "en"), (5, "a b c", "xx"), (None, "no id here", "en"), (None, None, None),
        (6, prose * 3, "en"), (6, prose * 3, "en"), (7, prose * 3, "en"), (8, (prose + "ünïcödé 漢字 🙂 ") * 3000, "en"), (9, "12345 !!! ###", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = {n: F.lit("x") for n in (
        "source", "fp", "fingerprint", "key", "hashes", "h", "size", "position", "copies", "text_hash", "item_id", "row_key", "ROW_HASH", "__key", "__hash", "__text", "__id", "kept", "start", "words")}
    return frame.withColumn("n_chars", F.length("text").cast("long")).withColumns(clash)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
