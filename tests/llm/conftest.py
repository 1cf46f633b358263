"""Small tables with nulls, empty and long texts, repeated rows and clashing column names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, norm string, id long, tokens long, rate double, text_sha256 string"
ENGLISH = "the thing and that other with this from there would have been under these words of the language "
GERMAN = "der die das und nicht ein eine mit auch für über schön größe straße werden können müssen "


def rows():
    texts = [
        (1, ENGLISH * 20, "en", "a"),
        (2, GERMAN * 20, "de", "a"),
        (3, ENGLISH * 20, "en", "a"),
        (3, ENGLISH * 20, "en", "a"),
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, " \t\n ", "de", None),
        (None, ENGLISH + "MIT License, cc-by and Apache  License 2.0", "en", "b"),
        (7, "12345 !!! ###", "en", "c"),
        (8, (ENGLISH * 30 + "\n") * 60, "en", "c"),
        (9, "short é text", "de", "c"),
        (10, ENGLISH * 19 + "changed", "en", "c"),
    ]
    return [(i, t, l, s, None, 5, "x", -1, 3, 0.5, "y") for i, t, l, s in texts]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return path


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(folder)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "empty.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
