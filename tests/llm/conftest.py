import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key long, found string"


def words_of(text):
    return (text or "").encode().split()


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows, clashing names."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeéñö") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = prose(70), "share this line everywhere"
    base = prose(120)
    texts = [None, "", " \n\t ", "one", "one", "two words", "a b c d", base, base, base + " end", "start " + base, passage]
    for i in range(40):
        w = base.split()
        w[(i * 3) % 120] = f"edit{i}"
        texts.append(" ".join(w))
    for _ in range(30):
        texts.append(prose(rng.randint(1, 80)) + " " + passage + " " + prose(rng.randint(1, 30)))
    for _ in range(30):
        texts.append(line + "\n" + prose(rng.randint(5, 60)) + "\n\n" + line + "\n" + prose(5))
    texts.append("word " * 5000)
    texts.append(prose(9000) + " " + passage)
    texts.append("tab\tsep\x0bvertical\x0cfeed\rreturn\nline nbsp stays   also " + prose(30))
    texts.append(prose(30).upper() + " " + passage.upper())
    rows = [(i, t, "en", f"s{i % 7}" if i % 9 else None, len(t or ""), "x", i, "y") for i, t in enumerate(texts)]
    rows += [rows[7], rows[20], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
