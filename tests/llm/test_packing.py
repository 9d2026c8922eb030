import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from postwright.llm import packing
from tests.llm.fixtures import ROWS, documents, no_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul ΣΑΣ x<|endoftext|>y it's", "a\x1cb c d ½² ŉ ǅ ẞ é", "don't 'S we'll 123abc", "", None, "\x85   <|startoftext|>"]


def expected(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, packing.END_ID], "<u4").tobytes() for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library():
    texts = ODD + [t for _, t in ROWS]
    assert packing.Encoder(PATH)(texts) == expected(texts)


def test_plain_texts_are_split_at_once():
    encoder, texts = packing.Encoder(PATH), ["Cook, cook!\tCOOK 12\n(cook) it's", "Küche. KÜCHE"]
    assert encoder(texts) == expected(texts)
    assert not encoder.words and set(encoder.parts) == {"cook", ",", "!", "1", "2", "(", ")", "it", "'s", "küche", "."}


def test_every_plain_sign_equals_the_library():
    signs = [chr(i) for i in range(9, 0x250)]
    texts = [f"a{c}B 1{c}2 {c}{c}' {c}'s '{c}S" for c in signs] + ["".join(signs[i::7]) for i in range(7)]
    assert packing.Encoder(PATH)(texts) == expected(texts)


def test_small_cache_gives_the_same():
    texts = [t for _, t in ROWS]
    encoder = packing.Encoder(PATH)
    encoder.words.size = encoder.parts.size = 7
    assert encoder(texts) == expected(texts)


def test_every_id_once_and_no_padding(spark):
    rows = packing.pack_documents(documents(spark), PATH).collect()
    ids = defaultdict(set)
    for (doc, _), x in zip(ROWS, expected([t for _, t in ROWS]), strict=True):
        ids[doc].add(x)
    windows, total = defaultdict(list), 0
    for r in rows:
        whole = next(x for x in ids[r["doc_id"]] if len(x) // 4 == r["doc_tokens"])
        piece = whole[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(piece) == r["ids_crc32"] and len(piece) == 4 * r["length"] > 0
        windows[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
        total += r["length"]
    assert total == sum(len(x) // 4 for x in expected([t for _, t in ROWS]))
    for pieces in windows.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at == pieces[0][2] <= 2048 and at & (at - 1) == 0


def test_step_groups_are_equal():
    windows, left = packing.pack([(i, 0, 1 + (i * 37) % 3000) for i in range(500)], True)
    assert not left and sum(n for tier, w in windows for _, _, n in w) == sum(1 + (i * 37) % 3000 for i in range(500))
    assert all(sum(n for _, _, n in w) == tier for tier, w in windows)


def test_empty_table(spark):
    assert packing.pack_documents(no_documents(spark), PATH).count() == 0
