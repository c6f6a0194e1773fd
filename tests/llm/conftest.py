import pytest

LONG = " ".join(f"word{i % 977} thing{i % 13}" for i in range(12_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and clashing column names."""
    rows = [(1, "The cat and the dog ran over the hill and then they slept.", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (4, LONG, "en", "b"), (5, "   \n\t ", "de", "b"),
            (6, "!!! ??? 123", "en", "a"), (7, "Der Hund und die Katze liefen über den Berg und schliefen dann.", "de", None), (7, "Der Hund und die Katze liefen über den Berg und schliefen dann.", "de", None),
            (8, "The cat and the dog ran over the hill and then they slept.", "en", "a"), (9, "x" * 5000, None, "b"), (None, "Der Hund und die Katze", "de", "b"), (10, "é漢🙂 ß\u0085 end", "de", "c")]
    rows = [(*r, 0, r[0], "clash", 1.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int, fp long, component_id string, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
