import pytest

#: Columns of the caller whose names the operators use themselves.
CLASHES = (
    "_id", "_h", "_n", "key", "size", "shard", "label", "component_id", "class_id", "range", "copy", "source_size",
    "__s", "__id", "__hash", "__key", "__size", "_f", "_s", "_key", "_size", "_drop", "_times", "_cut", "text_hash", "first_id", "c0", "c1", "_pair", "_keeper",
)


def document_rows():
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows, copies."""
    prose = [
        " ".join(f"w{(i * 7 + k * k) % 97}x{k % 13}" for k in range(30 + 5 * i)) + "\nA line that many share today\n" + f"end of {i}."
        for i in range(30)
    ]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}") for i, t in enumerate(prose)]
    rows += [
        (30, None, "en", "src0"), (31, "", "en", "src0"), (32, " \n\t ", None, None), (33, "one", "en", "src1"),
        (34, " ".join(f"long{k}" for k in range(30_000)), "en", "src1"), (35, prose[0], "en", "src2"), (36, prose[0] + " more", "fr", "src2"),
        (37, "é" * 5000, "fr", None), (38, "🙂 Ünïcode \x85 \xa0 text\x00end", "fr", "src3"), (39, prose[1].upper(), "en", "src3"),
        (None, "without an id but with words", "en", "src1"), (None, None, None, None),
    ]
    return rows + [rows[2], rows[2], rows[30]]


@pytest.fixture(scope="session")
def odd_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(document_rows(), "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(k))
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
