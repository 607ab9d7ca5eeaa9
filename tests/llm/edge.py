"""Small tables with every awkward case: nulls, empty and long texts, copies, clashing columns."""

import random

WORDS = "the of and river stone über naïve crossing lantern 42 meadow Winter copper thread hollow".split()

# Names that operators use for their own columns.
CLASHING = (
    "n_words n_hit score predicted component_id group class token size copies taken target rate text_ spans ranges "
    "_key_id _key_text anchor content begin windows wanted spare_order plan_source bucket order label_id html"
).split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ".", ","]) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = words(rng, 120)
    parts = base.split(" ")
    near = parts.copy()
    near[60] = "CHANGED"
    far = parts[:70] + words(rng, 70).split(" ")
    passage = words(rng, 45)
    out = [base, base, base.upper(), " ".join(near), " ".join(far), "", "   \n\t ", None, "one two", "one two", "ONE two"]
    out += [f"{words(rng, 20)} {passage} {words(rng, 25)}", f"{passage}\n{words(rng, 30)}", passage]
    out += ["again " * 200, "again and " * 90, words(rng, 5000), "é" * 500, "é" * 500 + "x", "a" * 399, "a" * 401]
    out += [words(rng, rng.randint(1, 60)) for _ in range(25)]
    return out


def documents(spark, seed=1, clashing=False):
    """Ids from 0; two rows without an id, the last rows repeat earlier ones."""
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ß", None]), len(t or "")) for i, t in enumerate(texts(seed))]
    rows += [(None, "nobody knows " * 20, "en", "a", 260), (None, None, None, None, None)]
    rows += [rows[0], rows[13], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    return df, rows


def components(n, links):
    """For each of n items the least item it is connected to."""
    low = list(range(n))

    def root(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def bag(rows):
    return sorted(map(repr, rows))
