"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, odd columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kinds string, n int, key string"

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))


def documents(spark, extra=()):
    texts = [
        None,
        "",
        "   \n\t ",
        "one",
        "two words",
        "a plain sentence of more than five words stands here",
        "a plain sentence of more than five words stands here",
        LONG,
        "Ünïcödé \U0001f642 漢字 ▁mark \\ <|im_end|> </s>",
        "\x00 control \x0b characters \x1f here",
    ]
    rows = [
        (i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "s", None, "x", None, i, "k")
        for i, t in enumerate(texts)
    ]
    rows += [rows[5], (None, "no id but some text in here", "en", "s", 3, None, None, None, None)]
    rows += [(i, t, "en", "s", len(t or ""), None, None, 0, None) for i, t in extra]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))
