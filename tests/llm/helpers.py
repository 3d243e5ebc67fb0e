"""Rows that every operator must bear: nulls, blanks, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)


def awkward():
    """(doc_id, text, source): copies, near copies, shared passages, nulls, blanks, a long text."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    passage = prose(2, 90)
    rows = [(i, prose(100 + i, 60), f"src{i % 3}") for i in range(12)]
    rows += [(20, base, "src0"), (21, base, "src0"), (22, near, "src1"), (23, base.upper(), "src2")]
    rows += [(30, f"{prose(3, 40)} {passage} {prose(4, 40)}", "src0"), (31, f"{prose(5, 50)}\n{passage}\t{prose(6, 20)}", None)]
    rows += [(40, None, "src1"), (41, "", "src1"), (42, " \t\r\n ", None), (43, "one two", "src0"), (44, "one two", "src2"), (45, "é" * 300 + " " + "ü" * 250, "src2")]
    rows += [(50, prose(7, 6000), "src0"), (None, prose(8, 30), "src0"), (None, None, None)]
    return rows
