"""Short licence notices in texts, exact phrases and fuzzy ones.

A notice may occur with some edited characters. It is cut into one more piece
than the edits allowed, so that one piece at least stands unedited (pigeonhole);
those exact seeds are searched in the whole normalised text, and the regex
library's bounded-error matching verifies the window around each. Normalised
text is its words, A-Z as a-z, joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from revlake.llm import bytetext as B

#: Phrases whose words stand consecutively, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices in normalised form, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
)


def edits_allowed(notice: str) -> int:
    return max(1, len(notice) // 12)


def seeds(notice: str) -> list[tuple[int, str]]:
    """Offset and text of the pieces, as equal in length as can be."""
    n = edits_allowed(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=64)
def _fuzzy(notice: str) -> regex.Pattern[str]:
    return regex.compile(f"(?:{regex.escape(notice, special_only=True)}){{e<={edits_allowed(notice)}}}", regex.BESTMATCH)


@lru_cache(maxsize=50_000)
def matched(notice: str, window: str) -> tuple[int, int, int] | None:
    """Begin, end and edits of the best match in a window, or None."""
    at = window.find(notice)
    if at >= 0:
        return at, at + len(notice), 0
    m = _fuzzy(notice).search(window)
    return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None


def normalised(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the normalised texts, each ended by a zero byte, and where each begins."""
    inside = B.ALNUM[body]
    before = np.append(False, inside[:-1]) if len(body) else inside
    before[offsets[:-1][offsets[:-1] < len(body)]] = False
    keep = inside | before
    out = np.where(inside, body, 0x20).astype(np.uint8)
    upper = (out >= 0x41) & (out <= 0x5A)
    out[upper] += 32
    begins = np.append(0, np.cumsum(keep))[offsets]
    ends = np.zeros(len(offsets) - 1, np.uint8)
    return np.insert(out[keep], begins[1:], ends), begins + np.arange(len(begins))


def fuzzy_places(text: bytes, starts: np.ndarray, notices=NOTICES) -> Iterator[tuple[int, int, int, int, int]]:
    """Text index, notice index, begin and end byte within the text, and edits of each place."""
    for k, (notice, _) in enumerate(notices):
        slack = edits_allowed(notice)
        windows: set[tuple[int, int, int]] = set()
        for offset, seed in seeds(notice):
            needle = seed.encode()
            at = text.find(needle)
            while at >= 0:
                doc = int(np.searchsorted(starts, at, "right")) - 1
                low = max(int(starts[doc]), at - offset - 4 * slack)
                # An edited character may have four bytes; the pattern itself bounds the match.
                high = min(int(starts[doc + 1]) - 1, at - offset + len(notice) + 4 * slack)
                windows.add((doc, low, high))
                at = text.find(needle, at + 1)
        taken: dict[int, int] = {}
        for doc, low, high in sorted(windows):
            while low > starts[doc] and text[low] & 0xC0 == 0x80:  # not inside a character
                low -= 1
            window = text[low:high].decode(errors="ignore")
            found = matched(notice, window)
            if found:
                begin = low + len(window[: found[0]].encode())
                if begin >= taken.get(doc, -1):  # windows of one place overlap
                    end = low + len(window[: found[1]].encode())
                    taken[doc] = end
                    yield doc, k, begin - int(starts[doc]), end - int(starts[doc]), found[2]


def scan(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each text."""
    n = len(offsets) - 1
    begins, ends, hashes = B.words(body, offsets, B.ALNUM)
    counts = B.counts_by_text(begins, offsets)
    first = np.append(0, np.cumsum(counts))
    owner = np.repeat(np.arange(n), counts)
    base: dict[int, list[tuple[int, str]]] = {}
    for phrase, label in BASE:
        parts = phrase.split(" ")
        hit = np.flatnonzero(hashes[: len(hashes) - len(parts) + 1] == np.uint64(B.word_hash(parts[0])))
        for j, part in enumerate(parts[1:], 1):
            hit = hit[(hashes[hit + j] == np.uint64(B.word_hash(part))) & (owner[hit + j] == owner[hit])]
        for i in hit.tolist():
            told = " ".join(bytes(body[begins[i + j] : ends[i + j]]).decode().lower() for j in range(len(parts)))
            if told == phrase:
                base.setdefault(int(owner[i]), []).append((i - int(first[owner[i]]), label))
    flat, starts = normalised(body, offsets)
    text = flat.tobytes()
    fuzzy: dict[int, list[tuple]] = {}
    for doc, k, low, high, edits in fuzzy_places(text, starts):
        notice, label = NOTICES[k]
        whole = text[starts[doc] : starts[doc + 1] - 1]
        fuzzy.setdefault(doc, []).append(
            (label, notice, whole.count(b" ", 0, low), whole.count(b" ", 0, max(low, high - 1)), edits, whole[low:high].decode())
        )
    for i in range(n):
        places, spans = base.get(i, []), sorted(fuzzy.get(i, []), key=lambda s: (s[2], s[3], s[1]))
        at = [p for p, _ in places]
        own = {label for _, label in places}
        near = max([1 - s[4] / len(s[1]) for s in spans], default=0.0)
        yield (
            int(counts[i]), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(own)),
            ",".join(sorted(own | {s[0] for s in spans})), 1.0 if own else near, spans,
        )


SPANS = "array<struct<label:string,notice:string,first_word:long,last_word:long,edits:int,text:string>>"
_COLUMNS = (
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))),
)
_PART = 8 << 20


def scan_licenses(documents: DataFrame) -> DataFrame:
    """Licence phrases and notices of all documents.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans. ``base`` columns tell the exact phrases; labels and spans also the
    notices found with edits; the score is 1 with an exact phrase, else 1 less
    the share of edited characters of the best notice, 0 without any. A null
    text is empty: no words, empty labels, score 0. Rows are independent:
    repeated ones give one row each; an empty table gives none; extra columns
    are ignored.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, sizes = B.flat(b.column(1))
            low = 0
            while low < len(b):  # parts of a batch, of about _PART bytes or one text
                high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + _PART, "right")) - 1)
                part = b.slice(low, high - low)
                columns = list(zip(*scan(*B.flat(part.column(1))), strict=True))
                arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", *(n for n, _ in _COLUMNS)])
                low = high

    schema = (
        f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string,"
        f" labels string, score double, spans {SPANS}"
    )
    return documents.select("doc_id", "text").mapInArrow(run, schema)
