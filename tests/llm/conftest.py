import random
import re

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, key string, keep_id string, blob string, n string, words string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents():
    """Rows with copies, near copies, shared passages, NULLs, ties, repeated rows and a very long text."""
    draw = random.Random(5)
    tongues = {
        "aa": "the of and ing tion ther here wha than other".split(),
        "bb": "der die und nicht ung keit schl über öff auch".split(),
    }

    def prose(lang, count):
        return " ".join("".join(draw.choice(tongues[lang]) for _ in range(draw.choice([1, 1, 2, 3]))) for _ in range(count))

    rows = []
    passage = prose("aa", 30)
    for k in range(60):
        lang = draw.choice(["aa", "bb"])
        text = prose(lang, draw.randint(25, 90))
        if k % 7 == 0:
            text = text + "\n" + passage + "\n" + prose(lang, 10)
        rows.append([k, text, lang if k % 9 else None, f"s{k % 5}" if k % 11 else None])
    base = prose("aa", 150).split(" ")
    for k in range(60, 75):
        words = list(base)
        words[draw.randrange(len(words))] = f"edit{k}"
        rows.append([k, " ".join(words), "aa", "s1"])
    for k in range(75, 95):
        rows.append([k, rows[3][1].replace(" ", "  ") if k % 2 else rows[3][1], rows[3][2], "s2"])
    rows += [[95, None, "aa", "s0"], [96, "", "bb", None], [97, " \t\n\x0b ", None, "s0"], [98, "1234 !! ..", "aa", "s3"]]
    rows += [[99, "é 日本語 \x00 ▁x <s>", "bb", "s3"], [100, "one", "aa", "s4"], [101, "One two", "aa", "s4"], [101, "One two", "aa", "s4"]]
    rows += [[None, rows[3][1], "bb", "s1"], [None, "no identifier here at all", "aa", "s1"], [None, None, None, None]]
    rows += [[102, "word " * 30_000, "aa", "s0"], [103, prose("aa", 40) + " " + prose("aa", 8) * 2, "aa", "s0"], [104, "token: abcdef1 " + "0" * 30, "aa", "s9"]]
    clash = ["x", None, "", "7", "b", None, "w"]
    return [tuple(r) + (None if k % 6 == 0 else len(r[1] or ""), *clash) for k, r in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)
