"""Rows that every document operator must bear: nulls, empty and long texts, repeats, clashing column names."""

import hashlib

WORDS = "the quiet river bends past seven old mills before it meets a wide grey sea near small towns".split()


def prose(seed: int, n: int) -> str:
    out = []
    for k in range(n):
        h = hashlib.md5(f"{seed}-{k}".encode()).digest()
        word = WORDS[h[0] % len(WORDS)] + (chr(97 + h[1] % 26) if h[2] % 3 == 0 else "")
        out.append(word.capitalize() if h[3] % 9 == 0 else word)
        if h[4] % 11 == 0:
            out[-1] += ".\n" if h[5] % 4 == 0 else "."
    return " ".join(out)


ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\t  ",
    "one",
    "two words",
    "Ünïcödé  spaces   here 　 and there",
    "<|endoftext|> inside <|endoftext|>",
    "tab\tand\r\nlines\n\n\n end ",
    "\U0001f600\U0001f468‍\U0001f469 emoji",
    "İstanbul ΑΣ ß",
    "x" * 5000,
    prose(1, 40),
    prose(1, 40),
    prose(2, 20_000),
]


def odd_documents(spark):
    """Documents with null and repeated ids, and columns that operators use names of themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 7, "k", b"h", 1.5) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id", None, None, None, None, None, None, None), (3, "again three", "en", "s", 11, 7, "k", b"h", 1.5), (3, "again three", "en", "s", 11, 7, "k", b"h", 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid long, kind string, h binary, score double").repartition(3)


def no_documents(spark):
    return odd_documents(spark).where("false")
