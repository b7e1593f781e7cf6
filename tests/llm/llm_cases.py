"""Small documents with the odd cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, doc int"


def words(rnd, n, vocabulary=400):
    return " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(vocabulary)}" for _ in range(n))


def texts(seed=3):
    rnd = random.Random(seed)
    plain = ["\n".join(words(rnd, rnd.randrange(4, 40)) for _ in range(rnd.randrange(1, 8))) for _ in range(60)]
    near = []
    for t in plain[:12]:
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    odd = [
        None, "", " ", "\n\n", "one", "two words", "  lead and trail  ", "tab\tand\x0bvertical\x0cform\rreturn",
        "Ünïcode ÀÉ İstanbul ΣΑΣ ς 漢字 😀 é", "a b c\x85d　e", "x" * 5000,
        "<|endoftext|> and <|startoftext|>x", "same line\nsame line\nother\nsame line", "A B C d e f\n" * 40,
        "▁ mark ▁▁ inside▁word", words(rnd, 6000), plain[0], plain[0], plain[1] + "\n" + plain[2],
    ]
    return plain + near + odd


def frame(spark, some=None, seed=3):
    rows = []
    for i, t in enumerate(texts(seed) if some is None else some):
        source = [None, "a", "b", "B", "é", "z"][i % 6]
        rows.append((i, t, "en", source, None if t is None else len(t), f"x{i}", i, -i))
    if some is None:
        rows.append(rows[5])
        rows.append((None, "a text without id here", None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
