"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "The and of to in that is was for on with by at from as it are."),
    (6, "The and of to in that is was for on with by at from as it are."),
    (6, "The and of to in that is was for on with by at from as it are."),
    (None, "The and of to in that is was for on with by at from as it are."),
    (7, "äöü ñandú élève ÇA 日本語 🙂 " * 40),
    (8, "x" * 30_000),
    (9, ("word%d " * 4000) % tuple(range(4000))),
    (10, " ".join(f"w{i}" for i in range(300)) + "\n" + " ".join(f"w{i}" for i in range(300))),
]
#: Names that operators use inside.
CLASHING = ("block", "row", "key", "keys", "label", "node", "score", "order", "name", "place", "kept_id", "bad_key", "a.b", "start")


def odd_documents(spark):
    rows = [(i, t, None if k == 3 else ("en", "fr")[k % 2], "s", *("z",) * len(CLASHING)) for k, (i, t) in enumerate(ODD_TEXTS)]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {names}")


def no_documents(spark):
    return odd_documents(spark).limit(0)


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
