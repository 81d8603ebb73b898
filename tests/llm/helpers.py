"""Small tables, and groups by brute force."""

from pyspark.sql import functions as F


def documents(spark, texts, ids=None, **extra):
    """A table of documents; extra columns carry names that operators use inside."""
    rows = [(i if ids is None else ids[i], t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "row", "fp", "id", "w", "hash", "pos", "gone", "words", "length", "block"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def components(n, linked):
    """The smallest member of each item's group, given a test of two items."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


EDGES = [None, "", " \n\t ", "one", "one two", "One TWO\x0bthree", "x" * 50_000, "word " * 20_000, "a\nb\nc\nd", "a\nb\nc\nd", "🙂 ünï 𝔘", "\x00 \x01"]
