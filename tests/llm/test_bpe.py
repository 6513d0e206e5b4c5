import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from cases import ODD, documents

from tablewright.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_equal_the_library(library):
    own, r = bpe.tokenizer(PATH, PATTERN), random.Random(1)
    texts = [t or "" for t in ODD]
    texts += ["".join(r.choice("ab é漢🤦\n  '1! \t\x1c\xa0") for _ in range(r.randrange(80))) for _ in range(500)]
    texts += ["".join(r.choice("aabs'") for _ in range(r.randrange(200))) for _ in range(200)]
    texts += ["ab" * 20000, "a" * 50000, "".join(r.choice("abcdefgh") for _ in range(50000)), " " * 3000 + "x"]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert ids == library.encode_ordinary(text), text[:50]
        assert own.decode(ids) == text.encode()


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    monkeypatch.setattr(bpe, "BATCH", 40)
    own, r = bpe.Tokenizer(bpe.read_ranks(PATH), PATTERN), random.Random(2)
    texts = [" ".join("wort%d," % r.randrange(20) for _ in range(15)) + r.choice(["", "  x", "\n "]) for _ in range(60)]
    assert list(own.encode_all(texts)) == [library.encode_ordinary(t) for t in texts]


def test_round_trip_of_a_table(spark, library):
    docs = documents(spark, ODD, [k // 2 for k in range(len(ODD))]).repartition(4)
    got = sorted(map(tuple, bpe.round_trip(docs, PATH, PATTERN).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for k, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        want.append((k // 2, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()), True))
    assert got == sorted(want)
    assert bpe.round_trip(documents(spark, []), PATH, PATTERN).count() == 0


def test_columns(spark, library):
    docs = documents(spark, ODD)
    ids = bpe.encode_column(docs, PATH, PATTERN)
    back = bpe.decode_column(ids, PATH, PATTERN)
    for row in back.collect():
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
