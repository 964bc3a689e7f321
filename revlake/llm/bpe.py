"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a block of texts are laid out as one array of symbols
with links to both neighbours. An index maps each pair that has a rank to all
its positions in the block. Ranks are applied in ascending order, each to all
its positions at once; only the lists of the neighbouring pairs change. A
merged symbol arises from one rank alone, so a pair that holds it ranks behind
that one and every word gets its merges in the order it would alone.

Blocks hold at most ``BLOCK`` characters or one text, which bounds memory.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revlake.llm.tables import frugal

BLOCK = 12_000_000
_CHUNK = 512
_SHIFT = np.int64(20)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def library_characters() -> dict[str, object]:
    """Letters, numbers, spaces and lower case as the tokenizers library knows them.

    Python's own tables may be of another Unicode version, so the classes are
    read from the library, as ranges for a pattern, and the differing lower
    case as a table.
    """
    from tokenizers import Regex
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split

    lower = Lowercase()
    classes = {name: Split(Regex(name), "removed") for name in (r"\p{L}", r"\p{N}", r"\s")}
    found: dict[str, list[np.ndarray]] = {name: [] for name in classes}
    other: dict[int, str] = {}
    for first in range(0, 0x110000, 0x8000):  # a part at a time, to spare the driver's memory
        points = [c for c in range(first, first + 0x8000) if not 0xD800 <= c < 0xE000]
        every = [chr(c) for c in points]
        text = "".join(every)
        for name, split in classes.items():
            left = "".join(part for part, _ in split.pre_tokenize_str(text))
            found[name].append(np.setdiff1d(np.array(points), np.fromiter(map(ord, left), np.int64)))
        # Each character between line feeds; the line feed itself has no case.
        lowered = lower.normalize_str("\n".join(c if c != "\n" else " " for c in every)).split("\n")
        other |= {ord(c): low for c, low in zip(every, lowered, strict=True) if c != "\n" and c.lower() != low}

    def ranges(parts: list[np.ndarray]) -> list[tuple[int, int]]:
        points = np.concatenate(parts)
        cuts = np.flatnonzero(np.diff(points) > 1)
        low, high = np.append(points[:1], points[cuts + 1]), np.append(points[cuts], points[-1:])
        return list(zip(low.tolist(), high.tolist(), strict=True))

    return {name: ranges(parts) for name, parts in found.items()} | {"lower": other}


def _pattern(word: str, characters: dict[str, object], top: int) -> re.Pattern[str]:
    """The splitting pattern for texts of characters up to ``top``; small classes match faster."""
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        within = [(low, min(high, top)) for low, high in characters[name] if low <= top]
        word = word.replace(name, "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in within))
    return re.compile(word)


class Vocabulary:
    """Symbols, ranks and splitting rules of a vocabulary file with word ends."""

    def __init__(self, content: str, characters: dict[str, object]):
        spec = json.loads(content)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.specials.items()}
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)))
        word = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word, self.latin = (_pattern(word, characters, top) for top in (0x10FFFF, 0xFF))
        self.lower = characters["lower"]
        symbols = byte_symbols()
        self.inner = np.array([ids[c] for c in symbols], np.int64)
        self.last = np.array([ids[c + self.end] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = np.array([ids[a] for a, _ in pairs], np.int64), np.array([ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left << _SHIFT | right
        order = np.argsort(keys)
        self.keys, self.key_ranks = np.append(keys[order], np.int64(1) << 62), np.append(order, -1)
        self.names = np.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], object)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs without one or beside an end."""
        keys = left << _SHIFT | right
        keys[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.key_ranks[at], -1)

    def pieces(self, text: str) -> Iterator[tuple[list[str], int]]:
        """Words of stretches of text (id -1), and special tokens by their id, in order."""
        at = 0
        for m in self.special.finditer(text):
            yield self.words(text[at : m.start()]), -1
            yield [], self.specials[m.group()]
            at = m.end()
        yield self.words(text[at:]), -1

    def words(self, text: str) -> list[str]:
        """Words of the composed text in lower case. Spaces need no folding: no word holds one."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:  # each character is lowered by itself: no final sigma
                lower = self.lower
                return self.word.findall("".join([lower.get(ord(c)) or c.lower() for c in text]))
        return self.latin.findall(text.lower())


def merge_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after another, and where each word's begin."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    body = np.frombuffer(b"".join(words), np.uint8)
    n = len(body)
    ends = np.cumsum(lengths)
    sym = np.append(vocabulary.inner[body], -1)
    sym[ends - 1] = vocabulary.last[body[ends - 1]]
    # Position n stands for "none" on either side; its symbol pairs with nothing.
    nxt, prv = np.arange(1, n + 2, dtype=np.int64), np.arange(-1, n, dtype=np.int64)
    nxt[ends - 1] = n
    nxt[n] = prv[n] = n
    prv[ends - lengths] = n
    rank = vocabulary.ranks(sym[:-1], sym[nxt[:-1]])
    found = np.flatnonzero(rank >= 0)
    chunks = -(-len(vocabulary.merged) // _CHUNK)
    waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(chunks)]

    def file(ranks: np.ndarray, at: np.ndarray) -> None:
        """Put positions under the chunk of their rank."""
        of = ranks // _CHUNK
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            waiting[of[part[0]]].append((ranks[part], at[part]))

    file(rank[found], found)
    for chunk in range(chunks):
        if not waiting[chunk]:
            continue
        ranks, at = (np.concatenate(x) for x in zip(*waiting[chunk], strict=True))
        waiting[chunk] = []
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        firsts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
        for low, high in zip(firsts, np.append(firsts[1:], len(ranks)), strict=True):
            index[int(ranks[low])].append(at[low:high])
        active = list(index)
        heapify(active)
        later: list[tuple[np.ndarray, np.ndarray]] = []
        while active:
            r = heappop(active)
            lists = index.pop(r, None)
            if lists is None:
                continue
            a, b = vocabulary.left[r], vocabulary.right[r]
            pos = np.unique(np.concatenate(lists)) if len(lists) > 1 or a == b else lists[0]
            q = nxt[pos]
            live = (sym[pos] == a) & (sym[q] == b)
            if not live.all():
                pos, q = pos[live], q[live]
            if not len(pos):
                continue
            if a == b:  # of a run that overlaps, every other one from the left
                starts = np.append(True, q[:-1] != pos[1:])
                begin = np.maximum.accumulate(np.where(starts, np.arange(len(pos)), 0))
                even = (np.arange(len(pos)) - begin) % 2 == 0
                pos, q = pos[even], q[even]
            after = nxt[q]
            sym[pos], sym[q] = vocabulary.merged[r], -1
            nxt[pos], prv[after] = after, pos
            nxt[n] = prv[n] = n
            before = prv[pos]
            place = np.concatenate([before, pos])
            new = vocabulary.ranks(sym[place], sym[nxt[place]])
            some = new >= 0
            if not some.any():
                continue
            new, place = new[some], place[some]
            near = new < (chunk + 1) * _CHUNK
            if near.any():
                for x, p in zip(new[near].tolist(), place[near], strict=True):
                    if x not in index:
                        heappush(active, x)
                    index[x].append(p.reshape(1))
                new, place = new[~near], place[~near]
            if len(new):
                later.append((new, place))
        if later:
            file(*(np.concatenate(x) for x in zip(*later, strict=True)))
    kept = sym[:-1] >= 0
    counts = np.add.reduceat(kept, ends - lengths) if n else np.zeros(0, np.int64)
    return sym[:-1][kept], np.append(0, np.cumsum(counts))


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _block(vocabulary: Vocabulary, texts: list[str]) -> Iterator[tuple[int, str, str]]:
    numbers = _Numbers()
    number = numbers.__getitem__
    plain, mixed = [], {}
    for i, text in enumerate(texts):
        parts = list(vocabulary.pieces(text))
        plain.append(np.fromiter(map(number, parts[0][0]), np.int32, len(parts[0][0])) if len(parts) == 1 else None)
        if len(parts) > 1:
            mixed[i] = [s if s >= 0 else np.fromiter(map(number, p), np.int32) for p, s in parts]
    ids, starts = merge_words(vocabulary, [w.encode() for w in numbers])
    counts = np.diff(starts)
    names = vocabulary.names[ids].tolist()
    numerals, bounds = list(map(str, ids.tolist())), starts.tolist()
    id_texts = [" ".join(numerals[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    token_texts = [" ".join(names[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    for i, of in enumerate(plain):
        parts = mixed.get(i, [of])
        n, idt, tok = 0, [], []
        for p in parts:
            if isinstance(p, int):
                n, idt, tok = n + 1, [*idt, str(p)], [*tok, vocabulary.tokens[p]]
            elif len(p):
                listed = p.tolist()
                n += int(counts[p].sum())
                idt.append(" ".join(map(id_texts.__getitem__, listed)))
                tok.append(" ".join(map(token_texts.__getitem__, listed)))
        yield n, " ".join(idt), " ".join(tok)


def encoded(vocabulary: Vocabulary, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
    """Of each text: number of tokens, ids joined by a space, decoded text."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK:
            yield from _block(vocabulary, block)
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield from _block(vocabulary, block)


def encode_documents(documents: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """Token counts and digests of all documents, and with ``keep`` ids and decoded text as well.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 (of the tokens joined as the vocabulary's decoder joins
    them). A null text is empty: no tokens, digests of the empty string. Strings
    of special tokens in a text become their ids. Repeated rows give one row
    each; an empty table gives none; extra columns are ignored. The vocabulary
    file is read on the driver and broadcast; its size is fixed by the file.
    """
    with open(path, encoding="utf-8") as f:
        content = documents.sparkSession.sparkContext.broadcast((f.read(), library_characters()))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if keep:
        schema, names = schema + ", ids array<int>, decoded string", [*names, "ids", "decoded"]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for group in _blocks(batches):
            vocabulary = vocabulary or Vocabulary(*content.value)
            texts = (t or "" for b in group for t in b.column(1).to_pylist())
            rows = list(encoded(vocabulary, texts)) if keep else [
                (n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
                for n, i, d in encoded(vocabulary, texts)
            ]
            at = 0
            for b in group:
                part = rows[at : at + len(b)]
                at += len(b)
                n, ids, decoded = (list(x) for x in zip(*part, strict=True)) if part else ([], [], [])
                columns = [b.column(0), pa.array(n, pa.int64())]
                if keep:
                    digest = lambda xs: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs], pa.string())
                    lists = pa.array([[int(x) for x in i.split()] for i in ids], pa.list_(pa.int32()))
                    columns += [digest(ids), digest(decoded), lists, pa.array(decoded, pa.string())]
                else:
                    columns += [pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.select("doc_id", "text").mapInArrow(frugal(encode), schema)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together up to about BLOCK bytes."""
    group, size = [], 0
    for b in batches:
        if group and size + b.nbytes > BLOCK:
            yield group
            group, size = [], 0
        group.append(b)
        size += b.nbytes
    if group:
        yield group
