"""Rows and column names that every operator must take."""

#: Rows every operator must take: nulls in each column, empty and blank texts, one very long
#: text, repeated rows and ids, texts of other scripts.
LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog while it rains on the old town.", "en", "a", 10),
    (1, "The quick brown fox jumps over the lazy dog while it rains on the old town.", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n\x0b\x0c\r ", "de", "b", 7),
    (None, "A text of a row without an id, which is kept and never compared by its id.", None, "b", 1),
    (None, None, None, None, None),
    (5, LONG, "en", "c", len(LONG)),
    (6, "12345 67890 !!! ???", "fr", "c", 3),
    (7, "日本語のテキスト　と　全角の空白 और हिन्दी مرحبا", "xx", "c", 3),
    (2, "The same id again, with other words than before: alpha beta gamma delta.", "en", "a", 5),
    (8, "one", "en", "a", 1),
    (9, "one", "en", "a", 1),
]
EXTRA = ("id", "node", "key", "tie", "score", "predicted", "words", "spans", "bucket", "_node", "_id", "n_words",
         "a.b", "lang_pred", "_first")
