from __future__ import annotations

import pytest

LONG = " ".join(f"word{k % 977} of" for k in range(30_000))
#: A null, an empty and a blank text, a very long one, ties and repeated rows, other scripts, digits, and repeated lines.
TEXTS = [
    None,
    "",
    "   \n ",
    LONG,
    "A short text.",
    "a  short\ttext.",
    "A short text.",
    "Ünïcode ﬁne Straße ΣΑΣ 漢字 ½",
    "Ünïcode fine STRASSE σας 漢字 1⁄2",
    "x" * 5000,
    "line one of the shared text here\nown words 1 2 3\nlog entry 17 took 35 ms today",
    "line one of the shared text here\nother words\nlog entry 18 took 99 ms today",
    "<|endoftext|> and <|startoftext|>",
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents of every odd kind; the last row repeats an id and its text, and the extra columns clash with names that operators use."""
    rows = [(k, t, "en", "s", len(t or ""), "k", k, "b", "f", 1, "v") for k, t in enumerate(TEXTS)]
    rows.append((*rows[4],))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n long, bucket string, fingerprint string, variant int, leaf string")


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables to a folder that queries read: folder(name, documents=df, ...)."""

    def put(name: str, **tables) -> str:
        path = f"file://{tmp_path_factory.mktemp(name)}"
        for k, df in tables.items():
            df.write.parquet(f"{path}/{k}.parquet")
        return path

    return put


@pytest.fixture(scope="session")
def edge_dir(spark, edge, folder):
    benchmark = spark.createDataFrame([(1, "line one of the shared text here"), (2, None), (3, ""), (4, " ".join(f"word{k % 977} of" for k in range(40))), (4, "word3 of")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (4, 1, 0), (4, 1, 0), (5, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>" + "long text " * 20_000)], "page_id long, url string, html string")
    vectors = [(1, [0.5, 1.0, -0.25]), (1, [0.5, 1.0, -0.25]), (2, None), (3, [None, 1.0, 1.0]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1.0, 2.0, 3.0]), (7, [0.0, 0.0, 0.0]), (8, [1.0]), (9, []), (None, [3.0, -1.0, 1.0])]
    embeddings = spark.createDataFrame([(*v, "x", 1, 2.0) for v in vectors], "vec_id long, embedding array<float>, key string, n long, whitened double")
    return folder("edge", documents=edge, benchmark=benchmark, labels=labels, pages=pages, embeddings=embeddings)


@pytest.fixture(scope="session")
def empty_dir(spark, edge, folder):
    none = lambda schema: spark.createDataFrame([], schema)
    return folder("empty", documents=edge.limit(0), benchmark=none("item_id long, text string"), labels=none("doc_id long, quality int, toxic int"), pages=none("page_id long, url string, html string"), embeddings=none("vec_id long, embedding array<float>"))
