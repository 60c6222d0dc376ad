"""Tables that every corpus operator must survive, and small brute-force helpers."""

import re

TEXTS = [
    "the cat sat on the mat and looked at the moon", "the cat sat on the mat and looked at the moon", None, "", "   \n\t ", "word", "Ünïcode Ærø ß 漢字 かな 🙂 é",
    "A B C D E F G H I J K L", "x" * 3000, "again " * 2000, "<|endoftext|> don't we'll 12,5 a.b. ..!. \x1c\x0b z", "The Cat Sat On The Mat And Looked At The Moon",
]


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t) if t else None, "extra", i) for i, t in enumerate(TEXTS)]
    rows += [(3, "", "en", "src0", 0, None, None), (None, "no id here", None, None, None, None, None), (None, None, None, None, None, None, None), rows[0], rows[0], (5, "another text of row five", "de", "s", 24, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, start long")


def empty_documents(spark):
    return odd_documents(spark).limit(0)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
