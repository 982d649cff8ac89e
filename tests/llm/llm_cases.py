"""Rows that every operator must take."""

LONG = " ".join(f"word{i % 977} and{i % 13}." for i in range(30_000))
#: Null and empty texts, a null id, a very long text, a repeated row, texts that tie.
ODD = [
    (1, None), (2, ""), (None, "no id here"), (3, LONG), (4, "the same text, twice"), (4, "the same text, twice"),
    (5, "the same text, twice"), (6, " \n\t "), (7, "1 2 3 +"), (8, "é"), (9, "漢字 🎉 mixed spaces  here"),
]
CLASHES = ("id", "th", "fp", "rest", "spans", "packed", "label", "part", "rank", "length", "root", "n", "key", "row", "kept")
