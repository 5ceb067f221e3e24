import hashlib
import random

import numpy as np
import pytest

from fleetpulse.llm import bpe
from fleetpulse.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


EDGES = [
    "",
    " ",
    "a",
    "x \nA  b\t\tc \n ",
    "§'s !'s it's don't 'll ''re é's _'ve 1's",
    "a<|endoftext|>b <|endoftext|> <|endof",
    " x　 y  z\u0085w  v u\x1c\x1fa​b",
    "zqxjkv" * 3000,
    "日本語テキスト 한국어 עברית 👩‍👩‍👧‍👦 \x00\x01﻿",
    "1234567890 3.14 --- ==== \r\n\r\n",
]


def test_equals_library(library):
    codec = bpe.codec(tokenizer_file())
    draw = random.Random(3)
    pieces = [" ", "  ", "\n", "'", "s", "re", "é", "§", "!", " ", "　", "a", "Zq", "7", "<|endoftext|>", "漢", "😀", "\t", "_", "\x85"]
    texts = EDGES + ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 30))) for _ in range(4000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_fragments_are_cut():
    parts = bpe.codec(tokenizer_file()).fragments(b"one two  three.\nFour")
    assert b"".join(parts) == b"one two  three.\nFour" and len(parts) > 3


def test_tables(spark, library):
    schema = "text string, doc_id long, ids string, n_tokens int"
    rows = [(t, i, "clash", 1) for i, t in enumerate(EDGES)] + [(None, 100, None, None), ("a", None, None, None), ("a", 1, "x", 0), ("a", 1, "x", 0)]
    docs = spark.createDataFrame(rows, schema)
    ids = bpe.encoded(docs, tokenizer_file())
    back = {(r.doc_id, r.text) for r in bpe.decoded(ids, tokenizer_file()).collect()}
    assert back == {(i, t or "") for t, i, *_ in rows}
    got = sorted(map(tuple, bpe.round_trip(docs, tokenizer_file()).collect()), key=str)
    want = []
    for t, i, *_ in rows:
        x = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0), tokenizer_file()).count() == 0
