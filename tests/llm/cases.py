"""Rows with the edge cases that every operator must give a defined result for."""

TABLES = {
    # edge cases shared by the operators: nulls, empty, blank, repeated rows, a long text,
    # ties, and extra columns whose names clash with those used inside
    "rows": [
        (1, "One two three four five six seven.", "a"),
        (1, "One two three four five six seven.", "a"),
        (2, "one  two\tthree four five six seven.", "a"),
        (3, None, None),
        (4, "", "b"),
        (5, " \n\t ", "b"),
        (None, "A text without an id.", None),
        (6, "long " * 30_000, "a"),
        (7, "Ünïcode ñandú straße — ok\n\nline\r\nline", "c"),
    ]
}
CLASHES = ("id", "norm", "hash", "data", "fp", "size", "draw", "n", "score", "_mix_x", "term", "segment", "block", "key")
