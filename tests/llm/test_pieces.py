import random

import numpy as np
import public_tokenizers
import sentencepiece

from postwright.llm import pieces
from tests.llm.fixtures import ROWS, documents, no_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  spaces   ", "tab\there\nline", "ééé 你好世界 😀😀 ﬁ Ａ", "aaaaaaaaaaaaaaaaaaaa", "http://x.example/?q=1&r=2", "the theory thereof", "\u0000​"]


def test_ids_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate(ODD + [t for _, t in ROWS])]
    found = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {i: library.encode(t or "") for i, t in rows}


def test_round_trip(spark):
    back = pieces.decode(pieces.encode(documents(spark), PATH), PATH).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((d or -1, (t or "").replace("▁", " ")) for d, t in ROWS)


def test_small_caches_give_the_same(monkeypatch):
    fst = pieces.Transducer(PATH)
    want = [fst.encode(t) for t in ODD]
    monkeypatch.setattr(pieces, "CACHED_WORDS", 2)
    monkeypatch.setattr(pieces, "PLACES", 8)
    small = pieces.Transducer(PATH)
    assert [small.encode(t) for t in ODD] == want
    assert np.frombuffer(want[0], "<u4").size == 0


def test_random_joins_of_pieces_equal_the_library():
    library, fst, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Transducer(PATH), random.Random(3)
    names = list(fst.ids)
    texts = ["".join(rng.choices(names, k=rng.randrange(1, 9))).replace("▁", " ") for _ in range(3000)]
    texts += ["".join(rng.choices("abcdeinrst    ABéü了中😀\n\t.,01▁", k=rng.randrange(50))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in fst.encode_all(texts)] == [library.encode(t) for t in texts]


def test_decoding_bytes_and_unknown_like_the_library():
    library, fst = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Transducer(PATH)
    for ids in ([], [0], [1, 2], [0, 300, 1], [*range(3, 259)][97:101], [fst.byte[b] for b in "é😀".encode()]):
        assert fst.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_decoding_random_ids_like_the_library():
    library, fst, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Transducer(PATH), random.Random(5)
    first = [fst.unknown, 1, 2, fst.byte[32], fst.byte[65], fst.ids["▁"], 300]
    for _ in range(2000):
        ids = [*rng.choices(first, k=rng.randrange(4)), *rng.choices(list(fst.ids.values()), k=rng.randrange(3))]
        assert fst.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_empty_table(spark):
    assert pieces.encode(no_documents(spark), PATH).count() == 0
