import pytest

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "


def prose(seed: int, words: int) -> str:
    """Words that hardly repeat, the same for the same seed."""
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(words):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(TEXT.split()[x >> 8 & 15] + str((x >> 12) % 9973))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empty and blank texts, a very long one, copies, near copies, shared passages, odd characters."""
    passage = prose(7, 60)
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "one two"), (6, "Größe ▁ 😀 tab\there"),
        (7, prose(1, 4000)), (8, prose(2, 120)), (9, prose(2, 120)), (10, prose(2, 119) + " changed"),
        (11, prose(3, 40) + " " + passage + " " + prose(4, 40)), (12, prose(5, 25) + "\n" + passage + "\n" + prose(6, 30)),
        (13, passage + " " + passage), (14, "SAME line here \nunique to fourteen\nsame LINE here"),
        (15, "same line here\nanother line altogether\n\n"), (16, "x" * 900), (17, "a b " * 150), (18, "\n\n\n"),
        (19, "ééé" * 90 + " end"), (20, "ééé" * 90 + " fin"),
    ]
    # Many texts around one common line and one common passage.
    rows += [(100 + i, prose(200 + i, 30 + i % 7) + "\na rather common line of text\n" + passage + "\n" + prose(400 + i, 12)) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with columns whose names the operators use inside."""

    def make(rows):
        wide = [(d, t, "en", "src", None if t is None else len(t), 1, 2, 3, "x") for d, t in rows]
        names = "doc_id long, text string, lang string, source string, n_chars long, key long, row int, did int, score string"
        return spark.createDataFrame(wide, names).repartition(3)

    return make
