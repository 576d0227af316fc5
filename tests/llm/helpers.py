"""Small document tables with the awkward cases every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "", "", ".", ",", "é"]) for _ in range(n))


def edited(text, seed, share):
    rng = random.Random(seed)
    words = text.split()
    for k in rng.sample(range(len(words)), max(1, int(len(words) * share))):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """(doc_id, text) with copies, near copies, shared passages, nulls, empties, a long text and repeated rows."""
    base, passage = prose(1, 300), prose(2, 80)
    rows = [(k, prose(100 + k, 60 + 7 * k)) for k in range(1, 25)]
    rows += [(30, base), (31, base), (32, base.upper())]
    rows += [(40 + k, edited(base, k, 0.01 + 0.01 * k)) for k in range(12)]
    rows += [(60 + k, f"{prose(200 + k, 40)} {passage} {prose(300 + k, 30)}") for k in range(4)]
    rows += [(70, passage), (71, " ".join(passage.split()[:49])), (72, " ".join(passage.split()[5:56]))]
    rows += [(80, None), (81, ""), (82, " \n\t "), (83, "one"), (84, "one"), (85, "One two"), (86, "the " * 300)]
    rows += [(90, prose(9, 30_000)), (91, "naïve café 😀 " * 60), (92, "a\x00b \x1c c")]
    rows += [(None, base), (None, None), (93, prose(77, 120)), (93, prose(77, 120)), (94, prose(78, 90)), (94, prose(79, 90))]
    return rows


def table(spark, rows, extra=True):
    df = spark.createDataFrame([(d, t, "en" if d is None or d % 3 else None, "s", None if t is None else len(t)) for d, t in rows], DOCS)
    if extra:  # columns with the names that the operators use inside
        df = df.selectExpr("*", "'x' AS id", "1 AS n", "'y' AS t", "2.5D AS score", "array(1) AS ids", "'z' AS tag", "0 AS bucket")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
