import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, ids=None, extra=()):
    """documents from texts, with further columns whose names operators might use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    schema = ", ".join([DOC_SCHEMA, *(f"{c} string" for c in extra)])
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *("x" for _ in extra)) for i, t in zip(ids, texts)], schema)


@pytest.fixture(scope="session")
def prose():
    """Seeded texts: plain, repeated, near copies, junk, other scripts, odd white space, empty, null, long."""
    r = random.Random(7)
    vocab = ["".join(r.choice(["th", "an", "re", "or", "ea", "é", "ß"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    out = [" ".join(r.choices(vocab, k=r.randint(1, 120))).capitalize() + "." for _ in range(40)]
    long = " ".join(r.choices(vocab, k=6000))
    shared = " ".join(r.choices(vocab, k=60))
    near = out[3].split(" ")
    near[len(near) // 2] = "changed"
    out += [out[0], out[0], " ".join(near), f"{out[5]}\n{shared}\n{out[6]}", f"A {shared} b", None, "", "  \n\t ", "one", "ONE two", "one two THREE",
            "a\x1cb c d\u0085e", "日本語 テキスト 日本語", "!!! ### $$$ !!! ### $$$ !!!", long, long + " tail", (out[7] + " ") * 4, "x" * 20000, "é ́x <|endoftext|> y"]
    return out
