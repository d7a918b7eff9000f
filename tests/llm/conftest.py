"""Documents with everything that may be odd about them."""

import random

import pytest

LONG = 40_000


def _sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def odd_rows():
    """(doc_id, text, lang) with nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    base = [_sentence(rng, 60) for _ in range(4)]
    rows = [(i, t, "xx") for i, t in enumerate(base)]
    rows += [
        (10, base[0], "xx"), (11, base[0] + " und mehr", "yy"), (12, "vorher " + base[1], "yy"), (10, base[0], "xx"),
        (13, None, "xx"), (14, "", None), (15, "   \n\t ", "xx"), (16, "a", "yy"), (17, "Zwei  Worte", "yy"),
        (18, base[2].upper() + "\n" + base[2] + "\n" + base[2], None), (None, base[3], "xx"), (None, None, None),
        (19, _sentence(rng, LONG), "xx"), (20, "x" * 3000, "yy"), (21, "中文字。 <|endoftext|> <s> ▁▁ \x00 e\u0301 don't!!", "yy"),
        (22, "\n".join([base[1], base[1].replace("a", "A"), base[1][:-3] + "zzz"]), "xx"), (23, "12 34 !!! -- ##", "xx"),
        (24, base[0][:80] + " " + base[3], "xx"), (25, "ab" * 200, "xx"),
    ]
    return rows


#: Names that operators use themselves.
CLASHING = (
    "ids decoded agrees batch bucket key line lines node root group size at shingle n_words score spans kept host "
    "items hit_words text_hash id a b u v hashes lang_pred text_read n_lines n_removed"
).split()


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string").repartition(3)
    return df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHING]).cache()


@pytest.fixture(scope="session")
def plain_rows(odd):
    return [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture
def shared(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))
