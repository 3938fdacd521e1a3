"""Inputs of the tests."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = (
    "word string, n long, th long, doc long, m long, s long, x int, fp long, score double, bits long, key long, pos int, gone long, keep long, r1 long, _r2 long, r2 long, d0 long, d1 long, row long, "
    "_doc long, _th long, _gone long, _keep long, _key string, _bad string, _id long, _r1 long, _row long, ids string, spans string, found string, train string, known long, lp double, c long, v1 long, "
    "nodes string, held_out string, words string, toxic string, label int, list string, own string, result string, component long, least string, unnamed boolean, n_dropped string, n_lines string, window string"
)


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared lines and passages, odd white space, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeghilmnorstuäñ") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, lines = words(60), [" ".join(words(6)) for _ in range(3)]
    docs = []
    for i in range(n):
        w = words(rng.randrange(1, 140))
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randrange(5) : rng.randrange(45, 61)]
        t = ""
        for k, x in enumerate(w):
            t += x.capitalize() if rng.random() < 0.1 else x
            t += rng.choice([" "] * 12 + ["\n", "  ", " \t", "\r\n", "\x0b", "  ", " "])
        if i % 3 == 0:
            t += "\n" + rng.choice([" ", "", "\t"]) + lines[i % 3].upper() + rng.choice(["", " ", "\r"])
        if i % 2 == 0:
            t = lines[1] + "\n" + t
        docs.append((i * 7, t))
    docs += [(10_000 + i, docs[i][1]) for i in range(0, 20, 3)]
    docs += [(20_000 + i, docs[i][1].replace("a", "A", 1) + rng.choice(["", " end", "\n\n"])) for i in range(0, 30, 4)]
    docs += [(30_001, None), (30_002, ""), (30_003, " \n\t"), (30_004, "\n" * 5), (30_005, "one"), (30_006, "two words"), (30_007, "日本語 🙂 \u0085 x"), (None, "no id here"), (30_008, ("again " * 3000) + "x" * 30_000)]
    return docs


def frame(spark, docs, clash=False):
    rows = [(i, t, None, None if k % 3 else "src0", None) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, KIND)
    if clash:
        for c in CLASH.split(", "):
            name, kind = c.split()
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df.repartition(3)


def order(rows):
    return sorted(map(tuple, rows), key=repr)
