"""Small documents for the operator tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, size=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def documents(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source)."""
    full = [(k, t, "en", rest[0] if rest else "s", len(t or "")) for k, t, *rest in rows]
    return spark.createDataFrame(full, DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
