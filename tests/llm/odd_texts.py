"""Texts that every operator must take: null, empty, blank, very long, repeated, odd characters."""

ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two"), (6, "ONE Two three"), (7, "a" * 30_000), (8, "word " * 20_000), (9, "x<|endoftext|>y"),
    (10, "日本語のテキスト。😀 ünïcödé"), (11, "same text of some words here"), (12, "same text of some words here"), (12, "same text of some words here"), (None, "a text without an id"), (None, None),
    (13, "▁ already ▁▁ there"), (14, "\x00 control \x85 chars　wide"), (15, "it's we'll 12,345 !!\n\n  end  "), (-5, "a negative id"),
]


def odd_frame(spark):
    """With columns whose names clash with those that operators add."""
    rows = [(i, t, "clash", 1.5, None, [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double, lang string, cells array<int>")


def empty_frame(spark):
    return odd_frame(spark).where("false")
