import random

import pytest


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with the awkward cases: nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(4)
    out = [(i, prose(rng, rng.randrange(1, 200))) for i in range(60)]
    base = prose(rng, 120)
    for i in range(60, 90):  # one base, one or two words changed each
        w = base.split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"x{i}"
        out.append((i, " ".join(w)))
    shared = prose(rng, 40)
    for i in range(90, 110):
        out.append((i, f"{prose(rng, 30)}\n{shared}\n{prose(rng, 25)}\n{shared if i % 2 else ''}"))
    out += [(110 + i, out[5][1]) for i in range(6)]  # copies
    out += [(120, None), (121, ""), (122, " \n\t "), (123, "one"), (124, "a b c d"), (125, "é" * 40 + " " + "ü" * 40), (126, "ab" * 4000), (127, "same line here\n" * 300), (128, "日本語 テキスト です " * 20)]
    out += [(129, prose(rng, 30_000)), (130, "NUL \x00 and | pipes # $ % " * 8), (131, "a b c d"), (132, "Ends with blank ")]
    out += [(None, base), (None, None), (7, out[7][1]), (7, out[7][1])]  # null ids and repeated rows
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    full = [(d, t, ("en", "de", None)[i % 3], ("src0", "src1", None)[i % 3], None if t is None else len(t), i, "x", -1, 0.5) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, bucket string, u int, weight double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
