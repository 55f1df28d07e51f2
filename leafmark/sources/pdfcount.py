"""A PDF's page count from its cross-reference data: from the newest revision's trailer to
the root's page tree. No page is read, so the text of a large file isn't touched."""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

_BLANK = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)*")
_NAME = re.compile(rb"/[^\x00\t\n\f\r ()<>\[\]{}/%]*")
_REF = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_WORD = re.compile(rb"true|false|null")
_OBJECT = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+obj")
_STREAM = re.compile(rb"stream\r?\n")
_ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])")


class Ref(NamedTuple):
    number: int


class Broken(ValueError):
    """Not what a PDF holds at this place."""


def parse(data: bytes, at: int) -> tuple[object, int]:
    """The value at a place, and the place behind it. Dictionaries have their names as keys."""
    at = _BLANK.match(data, at).end()
    if data.startswith(b"<<", at):
        out, at = {}, at + 2
        while not data.startswith(b">>", at := _BLANK.match(data, at).end()):
            name = _NAME.match(data, at)
            if not name:
                raise Broken("a dictionary's key isn't a name")
            out[name[0][1:].decode("latin-1")], at = parse(data, name.end())
        return out, at + 2
    if data.startswith(b"[", at):
        items, at = [], at + 1
        while not data.startswith(b"]", at := _BLANK.match(data, at).end()):
            item, at = parse(data, at)
            items.append(item)
        return items, at + 1
    if data.startswith(b"(", at):
        return _text(data, at)
    if data.startswith(b"<", at):
        end = data.find(b">", at)
        if end < 0:
            raise Broken("a string without an end")
        return data[at + 1 : end], end + 1
    for pattern, made in ((_NAME, lambda m: m[0].decode("latin-1")), (_REF, lambda m: Ref(int(m[1]))), (_NUMBER, lambda m: float(m[0]) if b"." in m[0] else int(m[0])), (_WORD, lambda m: {b"true": True, b"false": False}.get(m[0]))):
        found = pattern.match(data, at)
        if found:
            return made(found), found.end()
    raise Broken(f"no value at {at}")


def _text(data: bytes, at: int) -> tuple[bytes, int]:
    deep, i = 0, at
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            i += 1
        elif c == b"(":
            deep += 1
        elif c == b")":
            deep -= 1
            if not deep:
                return data[at + 1 : i], i + 1
        i += 1
    raise Broken("a string without an end")


def _unpredicted(raw: bytes, told: dict) -> bytes:
    """Undo the row filters of compressed tables."""
    if told.get("Predictor", 1) < 10:
        return raw
    width = (told.get("Columns", 1) * told.get("Colors", 1) * told.get("BitsPerComponent", 8) + 7) // 8
    step = max(1, told.get("Colors", 1) * told.get("BitsPerComponent", 8) // 8)
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(raw), width + 1):
        kind, row = raw[at], bytearray(raw[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            if kind == 1:
                row[i] = (row[i] + left) & 255
            elif kind == 2:
                row[i] = (row[i] + up) & 255
            elif kind == 3:
                row[i] = (row[i] + (left + up) // 2) & 255
            elif kind == 4:
                near = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))
                row[i] = (row[i] + near[2]) & 255
        out += row
        above = row + bytearray(width - len(row))
    return bytes(out)


class Document:
    def __init__(self, data: bytes):
        self.data, self.shift = data, max(0, data.find(b"%PDF-"))
        self.places: dict[int, tuple[str, int, int] | None] = {}
        self.trailer: dict = {}
        self.packed: dict[int, tuple[dict[int, int], bytes]] = {}

    def count(self) -> int:
        """The pages of the newest revision; raises :class:`Broken` where the tables don't tell."""
        at = self.data.rfind(b"startxref")
        start = re.compile(rb"startxref[\x00\t\n\f\r ]*(\d+)").match(self.data, at) if at >= 0 else None
        if not start:
            raise Broken("no cross-reference table")
        self._read_tables(int(start[1]))
        return self._pages(self.trailer.get("Root"))

    def recount(self) -> int:
        """The same by all objects that stand in the file, the last of each number."""
        self.places = {int(m[1]): ("at", m.start() - self.shift, 0) for m in _OBJECT.finditer(self.data)}
        self.packed.clear()
        roots, trees = [], []
        for at in re.finditer(rb"trailer", self.data):
            try:
                told, _ = parse(self.data, at.end())
                roots += [told["Root"]] if "Root" in told else []
            except (Broken, TypeError):
                continue
        for number in sorted(self.places, key=lambda n: self.places[n][1]):
            try:
                found = self.object(number)
            except (Broken, zlib.error, IndexError):
                continue
            kind = found.get("Type") if isinstance(found, dict) else None
            roots += [Ref(number)] if kind == "/Catalog" else [found["Root"]] if kind == "/XRef" and "Root" in found else []
            trees += [Ref(number)] if kind == "/Pages" and "Parent" not in found else []
            if kind == "/ObjStm":
                try:
                    inside = self._packed(number)[0]
                except (Broken, zlib.error):
                    continue
                self.places |= {n: ("in", number, 0) for n in inside if n not in self.places or self.places[n][0] == "in"}
        for root in reversed(roots):
            try:
                return self._pages(root)
            except (Broken, AttributeError, TypeError):
                continue
        for tree in reversed(trees):
            return self._number(self.resolve(tree).get("Count"))
        raise Broken("no page tree")

    def _pages(self, root: object) -> int:
        catalog = self.resolve(root)
        tree = self.resolve(catalog.get("Pages")) if isinstance(catalog, dict) else None
        if not isinstance(tree, dict):
            raise Broken("no page tree")
        return self._number(tree.get("Count"))

    def _number(self, value: object) -> int:
        value = self.resolve(value)
        if not isinstance(value, int) or value < 0:
            raise Broken("no page count")
        return value

    def _read_tables(self, start: int) -> None:
        """Tables from the newest back; what a newer one tells stands."""
        waiting, seen = [start], set()
        while waiting:
            start = waiting.pop(0)
            if start in seen:
                continue
            seen.add(start)
            at = _BLANK.match(self.data, start + self.shift).end()
            told = self._read_table(at + 4) if self.data.startswith(b"xref", at) else self._read_stream(at)
            for key, value in told.items():
                self.trailer.setdefault(key, value)
            waiting[:0] = [told[k] for k in ("XRefStm", "Prev") if isinstance(told.get(k), int)]

    def _read_table(self, at: int) -> dict:
        head = re.compile(rb"[\x00\t\n\f\r ]*(\d+) (\d+)[\x00\t\n\f\r ]*")
        while found := head.match(self.data, at):
            at, first = found.end(), int(found[1])
            for number in range(first, first + int(found[2])):
                entry = _ENTRY.match(self.data, at)
                if not entry:
                    raise Broken("a broken cross-reference table")
                self.places.setdefault(number, ("at", int(entry[1]), 0) if entry[3] == b"n" else None)
                at = _BLANK.match(self.data, entry.end()).end()
        at = _BLANK.match(self.data, at).end()
        if not self.data.startswith(b"trailer", at):
            raise Broken("no trailer")
        told, _ = parse(self.data, at + 7)
        if not isinstance(told, dict):
            raise Broken("no trailer")
        return told

    def _read_stream(self, at: int) -> dict:
        head = _OBJECT.match(self.data, at)
        if not head:
            raise Broken("no cross-reference table")
        told, end = parse(self.data, head.end())
        if not isinstance(told, dict) or told.get("Type") != "/XRef":
            raise Broken("no cross-reference table")
        raw, widths = self._decoded(told, end), told["W"]
        index = told.get("Index") or [0, told["Size"]]
        numbers = (n for first, size in zip(index[::2], index[1::2], strict=True) for n in range(first, first + size))
        for at, number in zip(range(0, len(raw), sum(widths)), numbers, strict=False):
            fields, place = [], at
            for width in widths:
                fields.append(int.from_bytes(raw[place : place + width], "big"))
                place += width
            kind = fields[0] if widths[0] else 1
            self.places.setdefault(number, ("at", fields[1], 0) if kind == 1 else ("in", fields[1], fields[2]) if kind == 2 else None)
        return told

    def _decoded(self, told: dict, at: int) -> bytes:
        head = _STREAM.match(self.data, _BLANK.match(self.data, at).end())
        size = self.resolve(told.get("Length"))
        if not head or not isinstance(size, int):
            raise Broken("no stream")
        raw, kinds, how = self.data[head.end() : head.end() + size], told.get("Filter"), told.get("DecodeParms")
        kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
        how = how if isinstance(how, list) else [how]
        if kinds == ["/FlateDecode"]:
            return _unpredicted(zlib.decompress(raw), self.resolve(how[0]) or {})
        if kinds:
            raise Broken(f"a stream of kind {kinds}")
        return raw

    def resolve(self, value: object) -> object:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.object(value.number)
        raise Broken("references in a circle")

    def object(self, number: int) -> object:
        kind, place, _ = self.places.get(number) or ("none", 0, 0)
        if kind == "none":
            return None
        if kind == "in":
            found, body = self._packed(place)
            return parse(body, found[number])[0] if number in found else None
        head = _OBJECT.match(self.data, _BLANK.match(self.data, place + self.shift).end())
        if not head or int(head[1]) != number:
            raise Broken(f"object {number} isn't where the table has it")
        return parse(self.data, head.end())[0]

    def _packed(self, number: int) -> tuple[dict[int, int], bytes]:
        """Places of the objects inside a compressed one, and its content."""
        if number not in self.packed:
            kind, place, _ = self.places.get(number) or ("none", 0, 0)
            head = _OBJECT.match(self.data, _BLANK.match(self.data, place + self.shift).end()) if kind == "at" else None
            if not head:
                raise Broken("no object stream")
            told, end = parse(self.data, head.end())
            if not isinstance(told, dict):
                raise Broken("no object stream")
            body, first = self._decoded(told, end), self._number(told.get("First"))
            pairs = list(map(int, body[:first].split()))
            self.packed[number] = {n: first + at for n, at in zip(pairs[::2], pairs[1::2], strict=False)}, body
        return self.packed[number]


def count(data: bytes) -> int:
    """Pages of a file; by its tables, or by its objects where these are broken."""
    try:
        return Document(data).count()
    except (Broken, KeyError, IndexError, TypeError, AttributeError, zlib.error):
        return Document(data).recount()
