"""Rows that every operator must survive."""

LONG = "alpha beta gamma delta " * 9_000
TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "word"), (5, LONG), (6, "the same row twice over and over again, friend of mine"),
    (6, "the same row twice over and over again, friend of mine"), (None, "no id here"), (8, "Ünïcode — “marks” 😀 ́ 中文 and\x00control"), (9, "x" * 60_000),
]


def documents(spark, rows=TEXTS):
    """Documents with other columns whose names an operator may use for itself."""
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 1, "z", 2.0) for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, text_hash string, score double")


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
