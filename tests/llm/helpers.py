"""Small tables with every edge case, written as the test data are."""

LONG = "word another %s. " * 4000


def documents(spark, folder):
    """Nulls in any column, empty and long texts, repeats, ties, odd signs, and columns whose names clash with ours."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away home.", "en", "a", 5),
        (2, "THE QUICK brown fox jumps over the lazy dog and runs away home.", "en", "a", 5),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, LONG % (("x",) * 4000), "en", "b", 1),
        (6, "one", None, "c", 1),
        (6, "one", None, "c", 1),
        (7, "123 ... \t\n", "de", None, 1),
        (None, "kein id hier <|endoftext|> und ' ende", "de", "c", 1),
        (8, "été à l'école — 日本語 😀 it's  ok\r\n\r\n  ", "fr", "d", 1),
        (9, "der hund und die katze gehen nach hause und schlafen dann sehr lange aus", "de", "d", 1),
        (10, "der hund und die katze gehen nach hause und schlafen dann sehr lange", "de", "d", 1),
        (-4, "nul\0byte", "en", "e", 1),
    ]
    df = spark.createDataFrame([(*r, "extra", k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key string, at int")
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return rows


def empty_documents(spark, folder):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, ids int, row string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")


def pages(spark, folder, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, low int").write.mode("overwrite").parquet(f"{folder}/pages.parquet")


def conversations(spark, folder, rows):
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, parts string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
