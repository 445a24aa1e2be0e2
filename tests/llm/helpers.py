"""Small tables with the awkward cases every operator has to take."""


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and to in is that for with as was on are by this be at from or an".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2147483648
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x // 65536 % 97))
    return " ".join(out)


def awkward_rows():
    long = sentence(5, 20000)
    return [
        (1, "One two three. " + sentence(1, 40), "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, "  \t\n\r\x0b\f ", "de", None, 5),
        (5, long, "fr", "a", len(long)),
        (6, sentence(6, 60) + "\n" + sentence(6, 60), "en", "b", 1),
        (6, sentence(6, 60) + "\n" + sentence(6, 60), "en", "b", 1),
        (-7, "Ünïcödé ſtraße ẞ İstanbul     x́ 日本語 🎉 " + sentence(7, 30), "de", "c", 1),
        (8, "word", None, None, None),
        (9, "$$$ ### a|b " * 20, "xx", "a", 3),
        (None, "no identifier here " + sentence(9, 12), "en", "a", 1),
    ]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def clashing(spark):
    """The awkward rows with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = awkward(spark)
    for c in ("t", "h", "id", "size", "n_words", "sig", "rep", "kept", "failed_bits", "k0", "f0", "start", "taken", "target"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Smallest generated tables, for queries against brute force.
SF = "/root/testdata/sf0.001"
