"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token with which its
encoding can end. The table of those last tokens is all that is kept: appending
bytes only extends it, an edit recomputes it from the edit until it agrees with
the old table again, and the encoding is read off backwards.

Defined results: a null or empty text has no tokens and the digest of no bytes;
repeated rows are encoded alike; very long texts are encoded whole, and very long
pieces take time in proportion to their length; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from leafmark.llm.common import documents, map_rows

#: Pieces whose encoding a worker remembers, and their longest size in bytes.
CACHED_PIECES, CACHED_BYTES = 400_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64(token) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def last_merges(ranks: dict[bytes, int]) -> np.ndarray:
    """For each token the two tokens whose merge makes it; for single bytes itself twice.

    Merging a token's bytes by rank, but never to the whole, must leave two parts.
    """
    out = np.empty((len(ranks), 2), np.int32)
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                raise ValueError(f"token {rank} isn't reached by merges")
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out[rank] = [ranks[p] for p in parts] if len(parts) == 2 else [rank, rank]
    return out


class Encoder:
    """Encodes single pieces; ``merges`` comes from :func:`last_merges`."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray):
        self.ranks, self.tokens = ranks, [b""] * len(ranks)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.left, self.right = merges[:, 0].tolist(), merges[:, 1].tolist()
        self.pairs = {(a, b): r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if len(self.tokens[r]) > 1}
        self.longest = max(map(len, ranks))
        self.fits = lru_cache(1_000_000)(self._fits)

    def _fits(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes followed by b's is just ``a, b``.

        Merges that would cross the seam are replayed backwards: of the two
        tokens at the seam the one made later is split, and no crossing merge
        may have been made before the split one.
        """
        left, right, pairs, before = self.left, self.right, self.pairs, len(self.tokens)
        while True:
            if pairs.get((a, b), before) < before:
                return False
            a_splits, b_splits = right[a] != a, left[b] != b
            if a_splits and (not b_splits or a > b):
                before, a = a, right[a]
            elif b_splits:
                before, b = b + 1, left[b]
            else:
                return True

    def last_tokens(self, data: bytes, table: list[int], start: int, old: list[int] | None = None, shift: int = 0) -> None:
        """Fill ``table`` (last token of each prefix; table[0] is unused) from ``start`` on.

        With ``old``, stop where ``longest`` successive entries agree with the old
        table at ``shift`` bytes before, and take the rest from it.
        """
        ranks, fits, agree = self.ranks, self.fits, 0
        for end in range(start, len(data) + 1):
            found = -1
            for size in range(min(self.longest, end), 0, -1):
                token = ranks.get(data[end - size : end])
                if token is not None and (size == end or fits(table[end - size], token)):
                    found = token
                    break
            if found < 0:
                raise ValueError("a byte of the text has no token")
            table.append(found)
            if old is not None and end - shift >= 0:
                agree = agree + 1 if old[end - shift] == found else 0
                if agree >= self.longest:
                    table.extend(old[end - shift + 1 :])
                    return

    def read(self, data_size: int, table: list[int]) -> list[int]:
        out, end = [], data_size
        while end:
            out.append(table[end])
            end -= len(self.tokens[table[end]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        table = [-1]
        self.last_tokens(data, table, 1)
        return self.read(len(data), table)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Piece:
    """One piece that can be appended to and edited without encoding it anew."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.table = encoder, data, [-1]
        encoder.last_tokens(data, self.table, 1)

    def append(self, data: bytes) -> None:
        start = len(self.data) + 1
        self.data += data
        self.encoder.last_tokens(self.data, self.table, start)

    def replace(self, start: int, end: int, data: bytes) -> None:
        old, shift = self.table, len(data) - (end - start)
        # Old entries are comparable only where their whole look-back lies after the edit.
        self.data = self.data[:start] + data + self.data[end:]
        usable = [x if i > end else -2 for i, x in enumerate(old)]
        self.table = old[: start + 1]
        self.encoder.last_tokens(self.data, self.table, start + 1, usable, shift)

    @property
    def ids(self) -> list[int]:
        return self.encoder.read(len(self.data), self.table)


class Pieces(dict):
    """Packed ids of pieces: little-endian unsigned 32-bit. Holds a bounded number."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        packed = np.array(self.encoder.piece(data), "<u4").tobytes()
        if len(data) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


_WORKER: dict[tuple[str, str], tuple[Encoder, Pieces, regex.Pattern]] = {}


def worker_state(key: str, ranks: bytes, merges: bytes, pattern: str) -> tuple[Encoder, Pieces, regex.Pattern]:
    """What a worker process keeps from task to task: one vocabulary's tables and pieces."""
    if (key, pattern) not in _WORKER:
        _WORKER.clear()
        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}
        encoder = Encoder(table, np.frombuffer(merges, np.int32).reshape(-1, 2))
        _WORKER[key, pattern] = encoder, Pieces(encoder), regex.compile(pattern)
    return _WORKER[key, pattern]


@lru_cache(2)
def vocabulary(path: str) -> tuple[str, bytes, bytes]:
    """Digest, rank file and merge table of a vocabulary, read on the driver.

    Both are of a fixed size (some 1.2 MB for 50k tokens), whatever the input.
    """
    with open(path, "rb") as f:
        ranks = f.read()
    return hashlib.sha256(ranks).hexdigest(), ranks, last_merges(read_ranks(path)).tobytes()


def encode(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the asked outputs of every whole text.

    outputs: ``ids`` (array<int>), ``ids_sha256`` (of the packed ids), ``decoded``
    (binary) and ``decoded_sha256`` (of the bytes that the ids decode to). No shuffle.
    """
    kinds = {"ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}
    docs = documents(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        encoder, pieces, cut = worker_state(*shared.value, pattern)
        packed, split = pieces.__getitem__, cut.findall

        def step(rows: dict) -> dict:
            out: dict[str, list] = {"doc_id": rows["doc_id"], "n_tokens": [], **{k: [] for k in outputs}}
            for text in rows["text"]:
                ids = b"".join(map(packed, split(text or "")))
                out["n_tokens"].append(len(ids) // 4)
                if "ids" in out:
                    out["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                if "ids_sha256" in out:
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                if "decoded" in out or "decoded_sha256" in out:
                    decoded = encoder.decode(array("I", ids))
                    if "decoded" in out:
                        out["decoded"].append(decoded)
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            return out

        return step

    return map_rows(docs, make, "doc_id long, n_tokens long" + "".join(f", {k} {kinds[k]}" for k in outputs))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of the ids (null ids: null; bytes that aren't UTF-8 are replaced)."""
    rows = encoded.selectExpr(f"cast({id_col} as long) as doc_id", f"cast({ids_col} as array<int>) as ids")
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path)[1])

    def make():
        tokens = {int(r): base64.b64decode(t) for t, r in map(bytes.split, shared.value.splitlines())}
        return lambda rows: {
            "doc_id": rows["doc_id"],
            "text": [None if ids is None else b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace") for ids in rows["ids"]],
        }

    return map_rows(rows, make, "doc_id long, text string")
