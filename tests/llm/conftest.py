import random

import pytest

WORDS = "the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()


@pytest.fixture(scope="session")
def texts():
    """Clean, copied, nearly copied, empty, odd and very long texts, with shared passages."""
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "s", "ing", "ed"]) for _ in range(n))
    passage = prose(90)
    base = prose(120)
    out = [prose(r.randint(60, 200)) for _ in range(12)]
    out += [base, base, base.replace("the", "thy", 1), base + " end", f"{prose(40)} {passage} {prose(50)}", f"{passage} {prose(20)}", f"{prose(30)}\n{passage}", passage]
    out += [None, "", "   ", "one two", "one two", "naïve café — ½ élan 'tis don't", "日本語のテキスト <|endoftext|> tail", "x" * 5000, "ab" * 900, prose(9000), "line\n" * 80]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with extra columns of names that the operators use themselves; a repeated row, and null ids."""
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), -i, f"c{i}", i / 2, "x") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "a row without an id " * 20, None, None, None, 0, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _c long, gram string, score double, kept string").repartition(3)
