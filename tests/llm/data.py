"""Small documents with every odd case: null, empty and blank texts, a very long one, copies, repeated rows, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id int"

EN = "the and of that with from house water light over under river people"
FR = "le la des une avec pour dans maison eau lumière rivière être peuple"


def sentence(rng, words, n):
    return " ".join(rng.choice(words.split()) + rng.choice(["", "", "a", "in", "er"]) for _ in range(n))


def rows():
    rng = random.Random(5)
    out = [(i, sentence(rng, EN if i % 2 else FR, 60 + i), "en" if i % 2 else "fr", "s", 0, 0.5, 1) for i in range(30)]
    base = out[3][1]
    words = base.split()
    out += [
        (100, None, "en", None, None, None, None), (101, "", None, "s", 0, 1.0, 2), (102, " \n\t ", "fr", "s", 4, 1.0, 2), (103, "two words", "en", "s", 9, 1.0, 2),
        (104, base, "en", "s", 1, 1.0, 2), (105, base, "en", "s", 1, 1.0, 2), (106, " ".join([*words[:-2], "changed", "end"]), "en", "s", 1, 1.0, 2),
        (107, sentence(rng, EN, 30_000), "en", "s", 1, 1.0, 2), (108, "x" * 70_000, "en", "s", 1, 1.0, 2), (109, "MIT License. General\nPublic license; Apache License", "en", "s", 1, 1.0, 2),
        (110, "# $ a\n# $ a\n\n#%", "en", "s", 1, 1.0, 2), (111, "日本語 🙂 é \x00 <|endoftext|> ß", None, "s", 1, 1.0, 2),
    ]
    return [*out, out[7]]  # a repeated row


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
