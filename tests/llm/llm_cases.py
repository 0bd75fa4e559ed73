"""Odd documents that every operator must handle."""

ODD = [
    (1, None), (2, ""), (3, " \n\t\n"), (4, "word"), (5, "a b c d e f"), (6, "x" * 3000), (7, "Über $$$ 10% | 中文 🙂 été"),
    (8, "line one\nline two\nline one\n"), (9, "line one\nline two\nline one\n"), (10, "don't we'll <|endoftext|> 's  it"),
]
