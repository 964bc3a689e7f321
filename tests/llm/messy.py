"""Documents that hold every odd case: nulls, empty and long texts, repeated rows, clashing columns."""

import random
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EXTRA = ("score", "held_out", "lang_pred", "key", "pos", "w", "removed", "_id", "shard", "place", "label", "bucket", "_own", "n",
         "_found_id", "_found_hash", "_found_covered", "n_lines", "n_removed", "_kept")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def texts():
    r = random.Random(5)
    words = ["the", "of", "and", "liber", "ardor", "él", "straße", "été", "MIT", "License", "x1", "zeta", "omega", "quux"]
    some = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(30)]
    long = " ".join(r.choice(words) + str(r.randint(0, 999)) for _ in range(30_000))
    return [
        None, "", " \n\t ", "123 !!! 456", "日本語のテキスト", "Σ ΑΣ İstanbul", "<|endoftext|> a <|startoftext|>b", long,
        "one", "one two three four", "One TWO three four five", "same text of some words here\nand\nlines", *some,
        "a\nb\nc\nd\na\nb\nc", "\n\n\n\n", "mit\nlicense", "\u0000x\x1cy\x85z", "é é",
    ]


def documents(spark):
    rows = [(i, t, "en" if i % 3 else None, None, None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [rows[11], rows[11], (9_000_000_000, rows[20][1], "fr", "s", 1), (None, rows[20][1], "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *("z" for _ in EXTRA)) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
