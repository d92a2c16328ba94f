import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docgraph.llm.bpe import ByteBPE, encode_documents
from docgraph.llm.token_files import WordEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Pieces that try pre-token rules, white space of all kinds, special strings, marks and case.
PARTS = [
    "a", "B", "'s", "'S", "'re", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "　", "​", " ", "é", "É", "é", "1", "２", "½", "!", "?", "$$$", "東京", "😀",
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "Hello", "world", "_", "\0", "ß", "İ", "ΑΣ", "ǅ", "﻿", "'", "''s", "Straße", "×", "÷", "ª", "µ", "ﬁ", "̈", "x" * 100, "ab " * 30,
]


def samples(seed, n=1500):
    rng = random.Random(seed)
    return ["", *PARTS, *("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(n))]


def test_ids_and_texts_equal_the_library():
    mine, theirs = ByteBPE(BYTES), Tokenizer.from_file(BYTES)
    for text in samples(1):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids, text
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    rng = random.Random(3)
    for _ in range(200):  # any ids, also those that end within a character
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_certain_cuts_are_inside_no_token():
    bpe = ByteBPE(BYTES)
    for token in bpe.ids:
        t = np.frombuffer(token, np.uint8)
        assert not bpe.certain[t[:-1], t[1:]].any()


def test_word_encoder_equals_the_library():
    mine, theirs = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    for text in samples(2):
        assert mine.encode(text.encode()).tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_documents(spark):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", None), (1, "Hello world", "x"), (None, "a <|endoftext|> b", "x"), (4, "word " * 40000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted([tuple(r) for r in encode_documents(df, BYTES, with_ids=True).collect()], key=str)
    theirs = Tokenizer.from_file(BYTES)
    want = []
    for doc_id, text, _ in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids, text or ""))
    assert got == sorted(want, key=str)
    assert encode_documents(df.limit(0), BYTES).count() == 0
