"""Documents with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, kept string, _row long, n long"
VOCABULARY = {"en": "the of and thing water house running over small morning light never".split(), "fr": "le la des maison être où déjà forêt petite lumière matin jamais".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "s", "ing", "x"]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(n))


def documents(seed=1, n=40):
    """(doc_id, text, lang) rows: prose, exact and near copies, shared passages, short, empty and null texts."""
    rng = random.Random(seed)
    shared = prose(rng, "en", 30)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = prose(rng, lang, rng.randrange(1, 120))
        if i % 7 == 3:
            words = rows[-1][1].split() if rows[-1][1] else ["x"]
            words[rng.randrange(len(words))] = "changed"
            text, lang = " ".join(words), rows[-1][2]
        if i % 9 == 4:
            text, lang = rows[0][1], rows[0][2]
        if i % 5 == 2:
            text = text + "\n" + shared + " " + prose(rng, "en", 5)
        rows.append((i * 3 + 5, text, lang))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "   \n", None), (1003, "é" * 200, None), (1004, "ab " * 3000, "en"), (1005, "ab " * 3000, "en"), (1006, "One", "en"), (1007, "one", "en"), (1008, "1234 !?", None), (None, "no number at all here", "en")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), 0.5, "k", None, 7, 1) for i, t, lang in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
