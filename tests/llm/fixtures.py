"""A small documents table with the awkward cases, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and house river stone walk slowly garden winter letter paper green light".split()


def documents(n=60, seed=1):
    """Rows with nulls, empty and very long texts, exact and near copies, and odd characters."""
    rng = random.Random(seed)
    sentence = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing"]) for _ in range(k))
    base = sentence(300)
    near = base.split()
    texts = [None, "", "   \n\t ", "one", "two words", base, base.replace(" ", "  \n"), base.upper(), sentence(9000),
             "a\x1cb c  d ́e café 中文 123 !!", "same text", "same \n text", "same text"]
    for k in range(12):
        words = list(near)
        words[k * 11] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [sentence(rng.randint(1, 60)) for _ in range(n - len(texts))]
    langs, sources = ["en", "fr", None], ["src0", "src0", "src0", "src1", None, "srcé"]
    return [(i * 3 + 1, t, rng.choice(langs), rng.choice(sources), len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows, clashes=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:  # extra columns whose names the operators use themselves
        from pyspark.sql import functions as F

        for name in ("fp", "norm", "ids", "shard", "slot", "size", "component_id", "simhash", "group", "lang_pred", "score"):
            df = df.withColumn(name, F.lit("x"))
    return df


def components(nodes, linked):
    """node -> smallest node reachable, from a function that lists links."""
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}
