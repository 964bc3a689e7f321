import hashlib
import random

import messy
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from revlake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH) as f:
        return bpe.Vocabulary(f.read(), bpe.library_characters())


def test_random_texts(library, vocabulary, monkeypatch):
    r = random.Random(1)
    alphabet = "aabbcé ß'tsSΣİ 1²٣ ́!.\n\x1c\x85日"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(800)]
    texts += ["aaaaaaa" * 40, "abab" * 50, "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "'''re'll"]
    monkeypatch.setattr(bpe, "BLOCK", 500)
    assert list(bpe.encoded(vocabulary, texts)) == [expected(library, t) for t in texts]
    assert list(bpe.encoded(vocabulary, ["", ""])) == [(0, "", "")] * 2


def test_every_character(library, vocabulary):
    texts = ["a" + chr(c) + "b" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    encodings = library.encode_batch(texts, add_special_tokens=False)
    for text, got, e in zip(texts, bpe.encoded(vocabulary, texts), encodings, strict=True):
        assert got[1] == " ".join(map(str, e.ids)), hex(ord(text[1]))


def test_messy_documents(spark, library):
    docs = messy.documents(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in texts:
        n, ids, decoded = expected(library, text)
        want.append((doc_id, n, digest(ids), digest(decoded)))
    order = lambda rows: sorted(map(str, rows))
    assert order(tuple(r) for r in bpe.encode_documents(docs, PATH).collect()) == order(want)
    kept = bpe.encode_documents(docs, PATH, keep=True).filter("doc_id = 10").first()
    assert " ".join(map(str, kept.ids)) == expected(library, dict(texts)[10])[1] and kept.decoded == expected(library, dict(texts)[10])[2]


def test_empty_table(spark):
    assert bpe.encode_documents(messy.empty(spark), PATH).count() == 0
