"""Encoding and decoding with merge-type piece vocabularies (SentencePiece BPE files).

A text's spaces become word marks, one more mark goes before it, and its characters are
symbols in a chain. An agenda holds the adjacent pairs whose join is a piece, best score
first, leftmost first among equals; the head is joined and its new neighbours enter the
agenda, until none is left. Pairs one of whose symbols has grown since are passed over.
A symbol that is no piece becomes its bytes' pieces. Signs that no piece joins, directly or
through others, can't meet, and no piece holds a mark behind another sign; so runs of signs
that may meet, with the marks before them, are encoded by themselves, and remembered. Each
Arrow batch is compared with the library's own ids and text.

Defined results: a null or empty text is the begin and end ids alone and decodes to an
empty text; a mark in a text counts as a space; repeated rows are encoded alike; very long
texts are encoded whole, in n log n steps however long a piece; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as formats

from leafmark.llm.common import documents, map_rows

MARK = "▁"
#: Segments whose encoding a worker remembers (some 200 bytes each), and their longest size in characters.
CACHED_SEGMENTS, CACHED_CHARS = 1_000_000, 48
#: Symbols up to which the agenda is a list that is searched, and not a heap.
SHORT = 40
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _pack(i: int) -> bytes:
    return i.to_bytes(4, "little")


def segment_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Cuts a text with marks where no piece reaches across: behind each run of signs of
    one kind, kinds being the connected parts of "stands beside it in a piece"."""
    kind: dict[str, str] = {}

    def kind_of(sign: str) -> str:
        while kind.setdefault(sign, sign) != sign:
            kind[sign] = sign = kind[kind[sign]]
        return sign

    for piece in pieces:
        if MARK in piece.lstrip(MARK):
            return re.compile("(?s).+")
        for a, b in pairwise(piece.lstrip(MARK)):
            kind[kind_of(a)] = kind_of(b)
    kinds: dict[str, list[str]] = {}
    for sign in kind:
        kinds.setdefault(kind_of(sign), []).append(sign)
    runs = ["[" + "".join(map(re.escape, signs)) + "]+" for signs in sorted(kinds.values(), key=len, reverse=True)]
    return re.compile(f"(?s){MARK}*(?:{'|'.join([*runs, f'[^{MARK}]'])})|{MARK}+")


class Vocabulary:
    """Pieces, scores and kinds of a model file. Raises for files of another kind."""

    def __init__(self, model: bytes):
        proto = formats.ModelProto()
        proto.ParseFromString(model)
        normal = proto.normalizer_spec
        if proto.trainer_spec.model_type != formats.TrainerSpec.BPE:
            raise ValueError("the vocabulary isn't of the merge type")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies that leave the text as it is are supported")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.prefix = MARK if normal.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.packed = {p: _pack(i) for p, i in self.ids.items()}
        #: Agenda keys: the least is joined first.
        self.order = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.packed_bytes = {b: _pack(i) for b, i in self.bytes.items()}
        self.unknown, self.begin, self.end = proto.trainer_spec.unk_id, proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.packed_unknown = _pack(self.unknown)
        self.unknown_surface = proto.trainer_spec.unk_surface
        self.segments = segment_pattern(self.ids)
        self.controls = frozenset(i for i, k in enumerate(self.kinds) if k == CONTROL)
        #: What each id adds to a decoded text.
        self.surface = [
            bytes([self.byte_of[i]]) if k == BYTE else b"" if k == CONTROL else self.unknown_surface.encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))
        ]


def symbols_of(segment: str, order: dict[str, float]) -> list[str]:
    """Join adjacent symbols by the agenda until no pair is a piece."""
    symbols, n = list(segment), len(segment)
    if n <= SHORT:
        return _short(symbols, order)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda = []
    for i in range(n - 1):
        key = order.get(symbols[i] + symbols[i + 1])
        if key is not None:
            agenda.append((key, i, i + 1, 2))
    heapify(agenda)
    while agenda:
        _, left, right, size = heappop(agenda)
        a, b = symbols[left], symbols[right]
        if not a or not b or len(a) + len(b) != size:
            continue
        symbols[left], symbols[right] = a + b, ""
        follows = after[left] = after[right]
        if follows < n:
            before[follows] = left
            joined = symbols[left] + symbols[follows]
            key = order.get(joined)
            if key is not None:
                heappush(agenda, (key, left, follows, len(joined)))
        ahead = before[left]
        if ahead >= 0:
            joined = symbols[ahead] + symbols[left]
            key = order.get(joined)
            if key is not None:
                heappush(agenda, (key, ahead, left, len(joined)))
    return [s for s in symbols if s]


def _short(symbols: list[str], order: dict[str, float]) -> list[str]:
    """The same, the agenda being a list by place: its first least entry is the head."""
    get = order.get
    agenda = [get(a + b, math.inf) for a, b in pairwise(symbols)]
    while agenda:
        key = min(agenda)
        if key == math.inf:
            break
        at = agenda.index(key)
        symbols[at] = joined = symbols[at] + symbols.pop(at + 1)
        del agenda[at]
        if at:
            agenda[at - 1] = get(symbols[at - 1] + joined, math.inf)
        if at < len(agenda):
            agenda[at] = get(joined + symbols[at + 1], math.inf)
    return symbols


class Encoder(dict):
    """Packed ids (little-endian unsigned 32-bit) of segments; remembers a bounded number."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.first, self.last = (_pack(i) if i >= 0 else b"" for i in (vocabulary.begin, vocabulary.end))

    def __missing__(self, segment: str) -> bytes:
        v, packed = self.vocabulary, b""
        for symbol in symbols_of(segment, v.order):
            known = v.packed.get(symbol)
            packed += known if known is not None else b"".join(v.packed_bytes[b] for b in symbol.encode()) if v.bytes else v.packed_unknown
        if len(segment) <= CACHED_CHARS:
            if len(self) >= CACHED_SEGMENTS:
                self.clear()
            self[segment] = packed
        return packed

    def encode(self, text: str | None, begin: bool = True, end: bool = True) -> bytes:
        v = self.vocabulary
        packed = b"".join(map(self.__getitem__, v.segments.findall(v.prefix + text.replace(" ", MARK)))) if text else b""
        if packed and not v.bytes:  # unknown signs that follow each other are one
            ids = np.frombuffer(packed, "<u4")
            packed = ids[np.append(True, (ids[1:] != v.unknown) | (ids[:-1] != v.unknown))].tobytes()
        return (self.first if begin else b"") + packed + (self.last if end else b"")

    def decode(self, ids: array | list[int]) -> str:
        v = self.vocabulary
        parts = list(map(v.surface.__getitem__, ids))
        for at, i in enumerate(ids):
            if v.kinds[i] != CONTROL:  # the mark before the text
                if v.prefix and v.kinds[i] == NORMAL and v.pieces[i].startswith(MARK):
                    parts[at] = parts[at][1:]
                break
        if v.controls.isdisjoint(ids[1:-1]):  # none parts the bytes of a sign
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return self._decode_runs(ids, parts)

    def _decode_runs(self, ids: array | list[int], parts: list[bytes]) -> str:
        """By runs of byte pieces: each byte that begins no sign of its run is U+FFFD."""
        out, run = [], b""
        for i, part in [*zip(ids, parts, strict=True), (-1, b"")]:
            if i in self.vocabulary.byte_of:
                run += part
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                run = run[size:]
            out.append(part.decode())
        return "".join(out)


_WORKER: dict[str, tuple[Encoder, sentencepiece.SentencePieceProcessor]] = {}


def worker_state(key: str, model: bytes) -> tuple[Encoder, sentencepiece.SentencePieceProcessor]:
    """What a worker process keeps from task to task: one vocabulary, and the library's."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(Vocabulary(model)), sentencepiece.SentencePieceProcessor(model_proto=model)
    return _WORKER[key]


@lru_cache(2)
def model_file(path: str) -> tuple[str, bytes]:
    """Digest and bytes of a model file, read on the driver: of a fixed size, whatever the input."""
    with open(path, "rb") as f:
        model = f.read()
    Vocabulary(model)  # raises here, not in tasks
    return hashlib.sha256(model).hexdigest(), model


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (begin and end among them) and the asked outputs of every whole text.

    outputs: ``ids`` (array<int>), ``ids_sha256`` (of the packed ids), ``decoded`` (string),
    ``decoded_sha256`` (of its UTF-8) and ``agrees`` (whether the library, run over the same
    Arrow batch, gives the same ids and decodes them to the same text). No shuffle.
    """
    kinds = {"ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string", "agrees": "boolean"}
    docs = documents(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model_file(path))
    reads = bool({"decoded", "decoded_sha256", "agrees"} & set(outputs))

    def make():
        encoder, library = worker_state(*shared.value)

        def step(rows: dict) -> dict:
            packed = list(map(encoder.encode, rows["text"]))
            out: dict[str, list] = {"doc_id": rows["doc_id"], "n_tokens": [len(p) // 4 for p in packed]}
            decoded = [encoder.decode(array("I", p)) for p in packed] if reads else []
            if "ids" in outputs:
                out["ids"] = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
            if "ids_sha256" in outputs:
                out["ids_sha256"] = [hashlib.sha256(p).hexdigest() for p in packed]
            if "decoded" in outputs:
                out["decoded"] = decoded
            if "decoded_sha256" in outputs:
                out["decoded_sha256"] = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
            if "agrees" in outputs:
                theirs = library.encode([t or "" for t in rows["text"]], add_bos=True, add_eos=True, num_threads=1)
                out["agrees"] = [array("I", ids).tobytes() == p and text == d for ids, p, text, d in zip(theirs, packed, library.decode(theirs, num_threads=1), decoded, strict=True)]
            return out

        return step

    return map_rows(docs, make, "doc_id long, n_tokens long" + "".join(f", {k} {kinds[k]}" for k in outputs))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of the ids (null ids: null)."""
    rows = encoded.selectExpr(f"cast({id_col} as long) as doc_id", f"cast({ids_col} as array<int>) as ids")
    shared = encoded.sparkSession.sparkContext.broadcast(model_file(path))

    def make():
        encoder, _ = worker_state(*shared.value)
        return lambda rows: {"doc_id": rows["doc_id"], "text": [None if ids is None else encoder.decode(ids) for ids in rows["ids"]]}

    return map_rows(rows, make, "doc_id long, text string")
