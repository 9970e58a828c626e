"""Small tables with the cases every operator must handle, and brute-force versions."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that operators use themselves
          "key string, node long, size int, label int, band long, shard string, score double, batch int, bucket int, "
          "tokens int, spans string, place int, root long, payload string, short int, kept string")
WORDS = ("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec "
         "romeo sierra tango uniform victor whiskey xray yankee zulu").split()


def prose(rnd: random.Random, words: int, line: int = 12) -> str:
    out = [rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(words)]
    return "\n".join(" ".join(out[i:i + line]) for i in range(0, words, line))


def edge_rows() -> list[tuple]:
    rnd = random.Random(7)
    base = prose(rnd, 120)
    near = base.replace(base.split()[60], "changed", 1)
    passage = prose(rnd, 90)
    texts = [
        base, base, near, None, "", "   \n\t ", "x", "é", "12 34", "!!", "中文 ЖЖ \U0001f600",
        prose(rnd, 60) + "\n" + passage, prose(rnd, 50) + "\n" + passage + "\n" + prose(rnd, 20),
        "a" * 3000, "ab" * 900 + "x" + "ab" * 700, "x<|endoftext|>y <|startoftext|>", prose(rnd, 9000), "same same same same",
        "same same same same",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(0, base), (None, near), (None, None), (40, prose(rnd, 30)), (40, prose(rnd, 30))]  # repeats, null ids, one id twice
    return [(i, t, "en" if k % 3 else None, "s", None if t is None else len(t), *[None] * 16) for k, (i, t) in enumerate(rows)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def union_find(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
