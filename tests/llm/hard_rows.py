"""Rows that every operator has to take."""

# ids and texts with NULLs, empty and very long texts, ties, repeated rows and columns whose names operators use themselves
HARD = [(1, "a b c d e f g"), (2, None), (3, ""), (None, "no id here, but a text"), (4, "x" * 200_000), (5, "one two three four five six " * 3000),
        (1, "a b c d e f g"), (6, "a b c d e f g"), (7, "ünïcödé 😀 text 日本語"), (8, "\n\n  \t"), (9, None), (None, "no id here, but a text")]
