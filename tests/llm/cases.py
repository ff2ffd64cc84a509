"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing column names."""

ODD_TEXTS = [
    None, "", " \t\n", "a", "one two three", "é😀 x@y.zz 4111111111111111", "1" * 5000, "a." * 3000 + "@", "a@" + "b.c." * 2000, "1 2 3 4 5 " * 3000,
    "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (651) 555-8500+1 2", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "a@b.c.d_x@y.z", "a@b..c@d.e", "@@a@b.c@d.e", "!!! ??? ...",
    "the quick brown fox jumps over the lazy dog and runs away", "the quick brown fox jumps over the lazy dog and runs away", "THE QUICK brown fox jumps over the lazy dog and runs away",
    "İstanbul ǅ ﬁ ² ½ don't we'll <|endoftext|> x", "word " * 4000,
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long"


def odd_documents(spark):
    langs, sources = ("en", "fr", None), ("src0", None, "src1", "src0")
    rows = [(k, t, langs[k % 3], sources[k % 4], len(t or ""), 0.5, 7) for k, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def save(df, path, name="documents"):
    df.coalesce(2).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def empty(spark, path, name="documents", schema=SCHEMA):
    return save(spark.createDataFrame([], schema), path, name)
