"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers by length. Each tier packs its own
windows, longest first; a window's gap is filled from shorter tiers, best fit
first, and the last tokens of a gap by a piece cut from a shorter document. So
every window is full, whatever its tier. Windows of one tier form step groups of
equal token counts.

A task packs the rows it reads, in groups of bounded size; what does not fill a
window is carried into its next group, and the rest of the last group becomes
windows of decreasing powers of two. Nothing is shuffled, so neither a hot
source nor repeated rows make one task larger, and a lost task packs its own
rows again to the same result.

Defined results: a null or empty text is the end id alone; a text of any length is
encoded whole and cut into as many pieces as it needs; of equally long pieces the one
read last is taken first; rows that repeat a doc_id, or a whole row, are packed as separate
documents; a null doc_id stays null in its pieces; an empty table gives no pieces;
extra columns, of whatever names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from postwright.llm.common import worker_keeps

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens that one group holds before it is packed, and tokens of a step group.
GROUP_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16
#: Words and parts of words whose ids a Python worker remembers in each of two generations, and the longest such one.
CACHED_WORDS, CACHED_PARTS, CACHED_LENGTH = 50_000, 150_000, 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


class _Known(dict):
    """key -> ids as little-endian uint32 bytes, computed on first sight; bounded: what one generation holds stays for the next."""

    def __init__(self, compute, size: int) -> None:
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Encoder:
    """ids of whole texts as little-endian uint32 bytes.

    The vocabulary's pre-tokeniser removes white space and never looks across
    it, so a text's ids are its words' ids in a row. What only holds Latin
    letters, digits and signs is normalised and split here, as the vocabulary's file
    says, whole texts at once, and the parts are encoded by its model; of any other text
    each word is taken so, or goes through the whole tokeniser. Words and parts are remembered,
    within a bound.
    """

    #: Signs from ! to ~ and from U+00A1 to U+024F, which are in normal form and lose case one by one; and white space.
    PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u0148\u014a-\u024f]*")
    PLAIN_TEXT = re.compile("[ \t-\r!-~\u00a1-\u012f\u0131-\u0148\u014a-\u024f]*")
    #: Contractions, letters, single digits and signs of such a text in lower case.
    LETTERS, DIGITS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u02af\u2c65\u2c66", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    PARTS = re.compile(rf"[{LETTERS}]+|[{DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^ \t-\r{LETTERS}{DIGITS}]+")

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.signs, self.model = _byte_signs(), self.tokenizer.model
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.parts, self.words = _Known(self._part, CACHED_PARTS), _Known(self._word, CACHED_WORDS)

    def _part(self, part: str) -> bytes:
        found = self.model.tokenize(part if part.isascii() and part.isalpha() else "".join(map(self.signs.__getitem__, part.encode())))
        return b"".join([self.bytes[t.id] for t in found])

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.PARTS.findall(text.lower())))

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.PLAIN.fullmatch(text) and not any(t in text for t in self.special):
            return self._split(text)
        return b"".join([self.bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _text(self, text: str) -> bytes:
        if self.PLAIN_TEXT.fullmatch(text) and not any(t in text for t in self.special):
            return self._split(text)
        return b"".join(map(self.words.__getitem__, text.encode("utf-8", "surrogatepass").split()))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        end = END_ID.to_bytes(4, "little")
        return [self._text(t or "") + end for t in texts]


def encoder(tokenizer_path: str) -> Encoder:
    """The worker's encoder; it outlives a task, and so do the words that it knows, until another operator needs the memory."""
    return worker_keeps(("packing", tokenizer_path), lambda: Encoder(tokenizer_path))


class Pool:
    """Items (document, start, length) by length, with the largest fitting one found by bit operations."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.by_length.setdefault(length, []).append((doc, start))
        self.mask |= 1 << length

    def _take(self, length: int) -> tuple[int, int, int]:
        items = self.by_length[length]
        doc, start = items.pop()
        if not items:
            del self.by_length[length]
            self.mask &= ~(1 << length)
        return doc, start, length

    def largest(self, most: int) -> tuple[int, int, int] | None:
        fitting = self.mask & ((1 << (most + 1)) - 1)
        return self._take(fitting.bit_length() - 1) if fitting else None

    def smallest(self) -> tuple[int, int, int] | None:
        return self._take((self.mask & -self.mask).bit_length() - 1) if self.mask else None

    def longest(self) -> int:
        return self.mask.bit_length() - 1 if self.mask else 0


def pack(lengths: list[tuple[int, int, int]], last: bool) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Pieces (document, start, length) -> full windows (tier, pieces) and the pieces that fill none yet.

    With ``last`` nothing is left: the rest goes to windows of decreasing powers of two.
    """
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    pool, top = Pool(), TIERS[0]
    for doc, start, length in lengths:
        while length >= top:
            windows.append((top, [(doc, start, top)]))
            start, length = start + top, length - top
        if length:
            pool.add(doc, start, length)
    left: list[tuple[int, int, int]] = []
    for tier, shorter in zip(TIERS, (*TIERS[1:], 0), strict=True):
        while pool.longest() > shorter:
            window, gap = [], tier
            while gap and (item := pool.largest(gap)):
                window.append(item)
                gap -= item[2]
            if gap and (donor := pool.smallest()):  # every item left is longer than the gap
                doc, start, length = donor
                window.append((doc, start, gap))
                pool.add(doc, start + gap, length - gap)
                gap = 0
            if gap:
                left += window
            else:
                windows.append((tier, window))
    if not last:
        return windows, left
    total = sum(length for _, _, length in left)
    left.reverse()
    while total:
        size = 1 << (total.bit_length() - 1)
        window, gap = [], size
        while gap:
            doc, start, length = left.pop()
            window.append((doc, start, min(gap, length)))
            if length > gap:
                left.append((doc, start + gap, length - gap))
            gap -= min(gap, length)
        windows.append((size, window))
        total -= size
    return windows, []


def _packer(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer_path), TaskContext.get().partitionId() << 32
        docs: dict[int, tuple[int | None, bytes]] = {}
        waiting: list[tuple[int, int, int]] = []
        sequence, number, tokens, steps = 0, 0, 0, dict.fromkeys(TIERS, 0)

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal sequence, waiting, tokens, docs
            windows, waiting = pack(waiting, last)
            columns: list[list] = [[] for _ in range(9)]
            for tier, window in windows:
                offset, step = 0, -1
                if tier in steps:
                    step = base | (TIERS.index(tier) << 28) | (steps[tier] * tier // STEP_TOKENS)
                    steps[tier] += 1
                for doc, start, length in window:
                    doc_id, ids = docs[doc]
                    row = (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, base | sequence, offset, tier, step)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += length
                sequence += 1
            docs = {doc: docs[doc] for doc, _, _ in waiting}
            tokens = sum(length for _, _, length in waiting)
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    docs[number] = (doc_id, ids)
                    waiting.append((number, 0, len(ids) // 4))
                    number, tokens = number + 1, tokens + len(ids) // 4
                if tokens >= GROUP_TOKENS:
                    yield flush(False)
        if waiting:
            yield flush(True)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents in windows of at most ``TIERS[0]`` tokens.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; tier is the
    window's size, step_id the group of windows of that tier that make one
    optimiser step (-1 for the last few windows of a task, below every tier).
    """
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer_path), SCHEMA)


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
