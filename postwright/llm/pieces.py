"""SentencePiece encoding and decoding as a weighted finite-state transducer, compiled to integer tables.

Three transducers are compiled from a model file. The normaliser has one state: it
maps white space to its visible sign and copies the rest, after the dummy prefix. The
piece transducer reads characters and writes pieces: arcs (state, character) ->
state of a trie whose final states are pieces; a character without an arc from the
start is written as its bytes. The bigram transducer has a state per piece and an arc
per pair of neighbours, with weight 0 if the merges of the model leave the two
apart and infinity otherwise. Its arcs are computed on demand, from two tables: which
pair of pieces makes which piece, and by which pair a piece is made. Undoing the
merges of both neighbours from the last to the first shows whether a pair across their
border would have come earlier.

Composed with an input the three give a lattice; its shortest path in the tropical
semiring (min, +) is the model's own segmentation, as a sequence of pieces is what the
merges yield exactly if every neighbouring pair is. At a place at most one piece ends
a path of finite weight, so the relaxation keeps one state a place. All new words of a
slice of texts are composed and relaxed together, place by place, on numpy arrays.

Pieces never hold the white space sign after another character, so the lattice
falls apart at word starts; words' paths are remembered, within a bound.

Defined results: a null or empty text has no pieces and decodes to an empty
text. The visible sign itself reads as a space, as in the library. Texts of any
length are encoded whole; repeated rows get equal results; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: What the unknown piece decodes to, as in the library.
UNKNOWN_TEXT = " ⁇ "
#: Words whose paths a worker remembers and the longest of them, texts whose new words are composed together, and places that one relaxation holds.
CACHED_WORDS, CACHED_LENGTH, AT_ONCE, PLACES = 300_000, 48, 512, 1 << 18
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: What ends the finite path to a place, if no piece does: nothing, or the start or a fallback.
NONE, FREE = -1, -2


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol-buffer message: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, raw[at : at + size]
            at += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, raw[at : at + size]
            at += size


class Arcs:
    """Arcs of a transducer as sorted integer keys: (source, label) -> target."""

    def __init__(self, source: np.ndarray, label: np.ndarray, target: np.ndarray, labels: int) -> None:
        keys = source.astype(np.int64) * labels + label
        order = np.argsort(keys, kind="stable")
        self.labels, self.keys, self.targets = labels, keys[order], target[order]

    def follow(self, source: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Targets, or NONE where there is no arc."""
        if not len(self.keys):
            return np.full(len(source), NONE)
        keys = source.astype(np.int64) * self.labels + label
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.targets[at], NONE)


class Transducer:
    """A compiled model."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            raw = file.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.dummy_prefix, trim, scores = True, True, []
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                if any(n == 3 and v != 2 for n, v in _fields(value)):
                    raise ValueError("only models of merges are compiled by this transducer")
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2 and v:
                        raise ValueError("a character map is not compiled by this transducer")
                    self.dummy_prefix = bool(v) if n == 3 else self.dummy_prefix
                    trim = bool(v) if n == 4 else trim
        if trim:
            raise ValueError("removal of extra white space is not compiled by this transducer")
        self.normaliser = {" ": SPACE}
        self.known: dict[str, bytes] = {}
        self._compile_pieces()
        self._compile_pairs(np.array(scores))
        self._compile_output()

    def _compile_pieces(self) -> None:
        """The trie: states in the order of their first appearance, state 0 the start."""
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER) and p}
        signs = sorted({ord(c) for p in self.ids for c in p})
        self.sign = np.full(0x110000, NONE, np.int32)  # code point -> label
        self.sign[signs] = np.arange(len(signs))
        arcs: dict[tuple[int, int], int] = {}
        final = [NONE]
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                key = (state, int(self.sign[ord(c)]))
                if key not in arcs:
                    arcs[key] = len(final)
                    final.append(NONE)
                state = arcs[key]
            final[state] = i
        self.longest = max(map(len, self.ids), default=0)
        self.final = np.array(final, np.int32)
        at = np.array(list(arcs), np.int64).reshape(-1, 2)
        self.trie = Arcs(at[:, 0], at[:, 1], np.array(list(arcs.values()), np.int32), max(1, len(signs)))
        # the first step, by label: characters without a piece or a longer piece are written as bytes
        self.first = self.trie.follow(np.zeros(len(signs), np.int64), np.arange(len(signs)))

    def _compile_pairs(self, scores: np.ndarray) -> None:
        """The tables of the bigram transducer: pair -> piece, and each piece's last merge."""
        size = len(self.pieces)
        order = np.unique(-scores, return_inverse=True)[1]
        self.rank = order.astype(np.int64)  # the less, the earlier
        left, right, whole = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(i)
        left, right, whole = (np.array(x, np.int64) for x in (left, right, whole))
        self.pairs = Arcs(left, right, whole.astype(np.int32), size)
        length = np.array([len(p) for p in self.pieces])
        self.left, self.right = np.full(size, NONE, np.int64), np.full(size, NONE, np.int64)
        self.reached = np.zeros(size, bool)
        self.reached[[i for p, i in self.ids.items() if len(p) == 1]] = True
        self.rank[self.reached] = -1  # a character is there from the start
        for n in range(2, self.longest + 1):
            at = np.flatnonzero(length[whole] == n)
            at = at[self.reached[left[at]] & self.reached[right[at]]]
            made = at[self.apart(left[at], right[at], self.rank[whole[at]])]
            first = made[np.unique(whole[made], return_index=True)[1]]
            self.left[whole[first]], self.right[whole[first]] = left[first], right[first]
            self.reached[whole[first]] = True

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the weight of each pair of neighbours is 0: no merge across their border comes before their own merges are done.

        Merges are undone from the last on; of two equal ones the right is the later.
        A pair across the border beats later merges, and an equal one to its right.
        """
        a, b, out = a.copy(), b.copy(), np.ones(len(a), bool)
        limit = np.full(len(a), len(self.rank) + 1) if until is None else until.copy()
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            made = self.pairs.follow(x, y)
            early = (made >= 0) & (self.rank[made] < limit[open_])
            out[open_[early]] = False
            open_, x, y = open_[~early], x[~early], y[~early]
            undo_left = self.rank[x] > self.rank[y]
            last = np.where(undo_left, x, y)
            more = self.left[last] >= 0
            open_, x, y, undo_left, last = open_[more], x[more], y[more], undo_left[more], last[more]
            limit[open_] = self.rank[last] + ~undo_left
            a[open_] = np.where(undo_left, self.right[x], x)
            b[open_] = np.where(undo_left, y, self.left[y])
        return out

    def _compile_output(self) -> None:
        """The texts of pieces, one after another as bytes; and the ids of bytes."""
        ids = range(len(self.pieces))
        self.byte = {int(self.pieces[i][3:5], 16): i for i in ids if self.kinds[i] == BYTE}
        self.unknown = next(i for i in ids if self.kinds[i] == UNKNOWN)
        text = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: UNKNOWN_TEXT.encode()}
        out = [text.get(k, lambda p: p.replace(SPACE, " ").encode())(p) for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.size = np.array([len(x) for x in out])
        self.start, self.text = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(out), np.uint8)

    def normalise(self, text: str) -> str:
        for sign, written in self.normaliser.items():
            text = text.replace(sign, written)
        return SPACE + text if self.dummy_prefix and text else text

    def paths(self, units: list[str]) -> list[bytes]:
        """The shortest path of each unit, as ids in little-endian uint32."""
        out: list[bytes] = [b""] * len(units)
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        at = 0
        while at < len(order):
            most = max(1, PLACES // max(1, len(units[order[at]])))
            part = [i for i in order[at : at + most]]
            while len(part) > 1 and len(part) * len(units[part[-1]]) > 2 * PLACES:
                part = part[: len(part) // 2]
            for i, ids in zip(part, self._relax([units[i] for i in part]), strict=True):
                out[i] = ids
            at += len(part)
        return out

    def _relax(self, units: list[str]) -> list[bytes]:
        """Composes the units with the transducers and relaxes the lattice place by place, for all units at once."""
        n, sizes = len(units), np.array([len(u) for u in units])
        width = int(sizes.max(initial=0))
        codes = np.full((n, width), -1, np.int64)
        codes[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        label = np.where(codes >= 0, self.sign[codes], NONE)
        ends = np.full((n, width + 1), NONE, np.int64)  # the piece that ends the finite path to a place
        begins = np.zeros((n, width + 1), np.int32)  # and where it begins
        ends[:, 0] = FREE
        unit = start = np.empty(0, np.int64)  # lattice arcs under way: unit, start, state of the trie
        state = np.empty(0, np.int64)
        for j in range(1, width + 1):
            sign = label[:, j - 1]
            live = sign[unit] >= 0
            unit, start, state = unit[live], start[live], state[live]
            state = self.trie.follow(state, sign[unit])
            fresh = np.flatnonzero((sign >= 0) & (ends[:, j - 1] != NONE))
            unit, start, state = np.concatenate([unit, fresh]), np.concatenate([start, np.full(len(fresh), j - 1)]), np.concatenate([state, self.first[sign[fresh]]])
            live = state >= 0
            unit, start, state = unit[live], start[live], state[live]
            piece = self.final[state].astype(np.int64)
            whole = np.flatnonzero(piece >= 0)
            whole = whole[self.reached[piece[whole]]]
            last, piece = ends[unit[whole], start[whole]], piece[whole]
            free = last == FREE
            pair, back = np.unique(np.where(free, 0, last) * len(self.pieces) + piece, return_inverse=True)
            finite = free | self.apart(pair // len(self.pieces), pair % len(self.pieces))[back]
            u, s, p = unit[whole[finite]], start[whole[finite]], piece[finite]
            ends[u, j], begins[u, j] = p, s
            # a character that no piece starts with and that is none itself is written as its bytes
            alone = np.flatnonzero((codes[:, j - 1] >= 0) & (ends[:, j - 1] != NONE) & ((sign < 0) | (self.final[np.maximum(self.first[sign], 0)] < 0)) & (ends[:, j] == NONE))
            ends[alone, j], begins[alone, j] = FREE, j - 1
        return self._read_back(units, sizes, ends, begins)

    def _read_back(self, units: list[str], sizes: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> list[bytes]:
        """The ids on each unit's path, from its last place to its first, for all units at once."""
        unit, place, steps = np.flatnonzero(sizes > 0), sizes[sizes > 0], []
        while len(unit):
            steps.append((unit, place, ends[unit, place]))
            place = begins[unit, place]
            unit, place = unit[place > 0], place[place > 0]
        if not steps:
            return [b""] * len(units)
        unit, place, piece = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((place, unit))
        unit, place, piece = unit[order], place[order], piece[order]
        edges = (4 * np.searchsorted(unit, np.arange(len(units) + 1))).tolist()
        raw = piece.astype("<u4").tobytes()
        out = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        for i in np.unique(unit[piece == FREE]).tolist():  # fallbacks are spelt out
            at, ids = place[edges[i] // 4 : edges[i + 1] // 4], []
            for j, x in zip(at.tolist(), piece[edges[i] // 4 : edges[i + 1] // 4].tolist(), strict=True):
                ids += [x] if x >= 0 else [self.byte.get(b, self.unknown) for b in units[i][j - 1].encode("utf-8", "surrogatepass")]
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        known = self.known
        cut = [_UNIT.findall(self.normalise(t or "")) for t in texts]
        new = list(set().union(*cut).difference(known))
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = list(set().union(*cut))
        known.update(zip(new, self.paths(new), strict=True))
        out = [b"".join(map(known.__getitem__, units)) for units in cut]
        for unit in [u for u in new if len(u) > CACHED_LENGTH] if len(known) <= CACHED_WORDS else new:
            del known[unit]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The piece transducer read backwards: the bytes that ids write, without the dummy prefix."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        places = np.repeat(self.start[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        text = self.text[places].tobytes()
        # only a piece has a dummy prefix: a space of the unknown piece's text or of a byte stays
        first = numbers[sizes > 0][:1]
        prefixed = self.dummy_prefix and len(first) and self.kinds[first[0]] in (NORMAL, USER) and text.startswith(b" ")
        return text[1:] if prefixed else text

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer; it outlives a task, and so do the words that it knows (CACHED_WORDS at most)."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def _encoder(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                texts = part.column(1).to_pylist()
                found = fst.encode_all(texts)
                columns = [part.column(0), pa.array([len(x) // 4 for x in found], pa.int64())]
                if digest:
                    whole = [fst.decode_bytes(x) == (t or "").replace(SPACE, " ").encode("utf-8", "surrogatepass") for x, t in zip(found, texts, strict=True)]
                    columns += [pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(whole)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])
                else:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids"])

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for batch in batches:
            texts = [fst.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids of every text."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(model_path, False), "doc_id long, n_pieces long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids -> doc_id, text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(model_path), "doc_id long, text string")


def op4(spark, sf_dir: str) -> DataFrame:
    """Every text of documents: its pieces, counted and digested, and whether they decode to it."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    return docs.mapInArrow(_encoder(public_tokenizers.path("piece_bpe_32k.model"), True), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
