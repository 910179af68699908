"""HDF5 files in plain Python: the part of the published file format that annotated-data and Seurat-style files use.

Reads superblocks 0 to 3, both object headers, groups by symbol tables or compact links, attributes, datasets that are compact,
contiguous or chunked by a version 1 B-tree, with deflate, shuffle and checksum filters, of integers, floats, booleans, complex
numbers, fixed and variable strings. Writes what the library itself writes by default: superblock 0, symbol tables, version 1
headers and B-trees; appendable datasets are chunked, optionally deflated. The interface is the common one of ``h5py``, which is
used instead where it is installed.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np

# Signatures, message numbers, node sizes and type codes are fixed by the format.
_SIGNATURE = b"\x89HDF\r\n\x1a\n"
_UNDEFINED = (1 << 64) - 1
_SPACE, _LINK_INFO, _TYPE, _FILL, _LINK, _LAYOUT, _FILTERS, _ATTRIBUTE, _MORE, _TABLE, _ATTRIBUTE_INFO = 0x1, 0x2, 0x3, 0x5, 0x6, 0x8, 0xB, 0xC, 0x10, 0x11, 0x15
_DEFLATE, _SHUFFLE, _CHECKSUM = 1, 2, 3
_LEAF, _GROUP_FAN, _CHUNK_FAN = 8, 32, 64
_REFERENCE = np.dtype([("size", "<u4"), ("heap", "<u8"), ("index", "<u4")])


def string_dtype() -> np.dtype:
    return np.dtype(object)


def _padded(raw: bytes, to: int = 8) -> bytes:
    return raw + bytes(-len(raw) % to)


class _Type:
    """A stored type: how elements lie in the file and what they are in numpy."""

    def __init__(self, size: int, stored: np.dtype | None = None, kind: str = "other"):
        self.size, self.kind, self.stored = size, kind, stored or np.dtype(f"V{size}")

    @property
    def dtype(self) -> np.dtype:
        return {"text": np.dtype(object), "bool": np.dtype(bool)}.get(self.kind, self.stored)


def _type_of(raw: bytes, at: int = 0) -> tuple[_Type, int]:
    """The type described at a place and where its description ends."""
    head, bits, size = raw[at], int.from_bytes(raw[at + 1 : at + 4], "little"), int.from_bytes(raw[at + 4 : at + 8], "little")
    version, sort, at = head >> 4, head & 15, at + 8
    order = ">" if bits & 1 else "<"
    if sort == 0:
        return _Type(size, np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"), "number"), at + 4
    if sort == 1:
        return _Type(size, np.dtype(f"{order}f{size}"), "number"), at + 12
    if sort == 3:
        return _Type(size, np.dtype(f"S{size}"), "fixed"), at
    if sort == 6:
        members = []
        for _ in range(bits & 0xFFFF):
            end = raw.index(b"\0", at)
            name, at = raw[at:end], (end + 1 if version == 3 else at + (end - at + 8) // 8 * 8)
            at += (1 if size < 1 << 8 else 2 if size < 1 << 16 else 4) if version == 3 else 4 if version == 2 else 32
            member, at = _type_of(raw, at)
            members.append((name, member))
        is_complex = [n for n, _ in members] == [b"r", b"i"] and all(m.kind == "number" and m.stored.kind == "f" for _, m in members)
        return _Type(size, np.dtype(f"{members[0][1].stored.str[0]}c{size}") if is_complex else None, "complex" if is_complex else "other"), at
    if sort == 8:
        base, at = _type_of(raw, at)
        names = []
        for _ in range(bits & 0xFFFF):
            end = raw.index(b"\0", at)
            names.append(raw[at:end])
            at = end + 1 if version == 3 else at + (end - at + 8) // 8 * 8
        return _Type(size, base.stored, "bool" if sorted(names) == [b"FALSE", b"TRUE"] else "number"), at + len(names) * base.size
    if sort == 9:
        _, at = _type_of(raw, at)
        return _Type(size, _REFERENCE, "text" if bits & 15 == 1 else "other"), at
    return _Type(size), len(raw)


def _described(dtype: np.dtype) -> bytes:
    """The description of a numpy type."""
    kind, size = dtype.kind, dtype.itemsize
    if kind in "iu":
        return struct.pack("<BBHIHH", 0x10, 8 if kind == "i" else 0, 0, size, 0, 8 * size)
    if kind == "f":
        exponent, mantissa = {2: (5, 10), 4: (8, 23), 8: (11, 52)}[size]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, mantissa, exponent, 0, mantissa, (1 << (exponent - 1)) - 1)
    if kind == "b":
        return struct.pack("<BBHI", 0x18, 2, 0, 1) + _described(np.dtype("i1")) + _padded(b"FALSE\0") + _padded(b"TRUE\0") + b"\0\1"
    if kind == "S":
        return struct.pack("<BBHI", 0x13, 0x01, 0, max(1, size))
    if kind == "O":  # variable strings in UTF-8
        return struct.pack("<BBBBI", 0x19, 1, 1, 0, 16) + _described(np.dtype("u1"))
    if kind == "c":
        part = _described(np.dtype(f"<f{size // 2}"))
        return struct.pack("<BBHI", 0x16, 2, 0, size) + b"".join(_padded(name) + struct.pack("<IB3x4x4x16x", k * size // 2, 0) + part for k, name in enumerate((b"r\0", b"i\0")))
    raise TypeError(f"no stored type for {dtype}")


class _In:
    """The bytes of a file that is read."""

    def __init__(self, path: str):
        self.fd = os.open(path, os.O_RDONLY)
        self.heaps: dict[int, tuple[bytes, dict[int, int]]] = {}
        size, self.base = os.fstat(self.fd).st_size, 0
        while os.pread(self.fd, 8, self.base) != _SIGNATURE:
            self.base = self.base * 2 or 512
            if self.base >= size:
                raise OSError(f"{path} is no HDF5 file")
        head = self.at(0, 100)
        if head[8] < 2:
            if head[13:15] != b"\x08\x08":
                raise OSError("only files with 8-byte offsets and lengths can be read")
            self.root = struct.unpack_from("<Q", head, 64 + 4 * head[8])[0]
        else:
            if head[9:11] != b"\x08\x08":
                raise OSError("only files with 8-byte offsets and lengths can be read")
            self.root = struct.unpack_from("<Q", head, 36)[0]

    def at(self, place: int, size: int) -> bytes:
        return os.pread(self.fd, size, self.base + place)

    def read(self, place: int, size: int) -> bytes:
        """All of ``size`` bytes."""
        raw, got = [], 0
        while got < size:
            part = self.at(place + got, size - got)
            if not part:
                raise OSError("the file is cut short")
            raw.append(part)
            got += len(part)
        return raw[0] if len(raw) == 1 else b"".join(raw)

    def messages(self, place: int) -> list[tuple[int, bytes]]:
        """The messages of an object header: (number, body)."""
        head, out = self.at(place, 32), []
        if head[:4] == b"OHDR":
            flags, at = head[5], 6
            at += (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.at(place + at, width), "little")
            blocks, extra = [(place + at + width, size)], 2 if flags & 4 else 0
            while blocks:
                raw, i = self.read(*blocks.pop(0)), 0
                while i + 4 + extra <= len(raw):
                    number, size, shared = raw[i], int.from_bytes(raw[i + 1 : i + 3], "little"), raw[i + 3] & 2
                    body = raw[i + 4 + extra : i + 4 + extra + size]
                    i += 4 + extra + size
                    if number == _MORE:
                        start, length = struct.unpack("<QQ", body[:16])
                        blocks.append((start + 4, length - 8))
                    elif number:
                        out.append((number, b"" if shared else body))
            return out
        if head[0] != 1:
            raise OSError("unknown object header")
        left, size = struct.unpack_from("<H", head, 2)[0], struct.unpack_from("<I", head, 8)[0]
        blocks = [(place + 16, size)]
        while blocks and left:
            raw, i = self.read(*blocks.pop(0)), 0
            while i + 8 <= len(raw) and left:
                number, size, flags = struct.unpack_from("<HHB", raw, i)
                body, left = raw[i + 8 : i + 8 + size], left - 1
                i += 8 + size
                if number == _MORE:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                elif number:
                    out.append((number, b"" if flags & 2 else body))
        return out

    def links(self, tree: int, heap: int) -> Iterator[tuple[str, int]]:
        """Names and object headers of a symbol table."""
        size, _, data = struct.unpack("<QQQ", self.read(heap + 8, 24))
        names = self.read(data, size)
        for _, place in self.leaves(tree, 8, 0):
            head = self.read(place, 8)
            n = struct.unpack_from("<H", head, 6)[0]
            for name, header in struct.iter_unpack("<QQ24x", self.read(place + 8, 40 * n)):
                yield names[name : names.index(b"\0", name)].decode(), header

    def leaves(self, place: int, key: int, kind: int, wanted: Any = None) -> Iterator[tuple[bytes, int]]:
        """Keys and children of the lowest level of a B-tree; ``wanted`` tells from two keys whether to look between them."""
        if place == _UNDEFINED:
            return
        head = self.read(place, 24)
        if head[:4] != b"TREE" or head[4] != kind:
            raise OSError("unknown index of chunks or names")
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        raw = self.read(place + 24, n * (key + 8) + key) if n else b""
        for i in range(n):
            at = i * (key + 8)
            low, child = raw[at : at + key], struct.unpack_from("<Q", raw, at + key)[0]
            if wanted is not None and not wanted(low, raw[at + key + 8 : at + 2 * key + 8]):
                continue
            if level:
                yield from self.leaves(child, key, kind, wanted)
            else:
                yield low, child

    def texts(self, references: np.ndarray) -> list[bytes]:
        """Variable strings from the collections that hold them."""
        out, now = [], None
        for size, heap, index in references.tolist():
            if not size or heap in (0, _UNDEFINED):
                out.append(b"")
                continue
            if heap not in self.heaps:
                if len(self.heaps) > 64:
                    self.heaps.clear()
                raw = self.read(heap, struct.unpack("<Q", self.read(heap + 8, 8))[0])
                words = np.frombuffer(raw, "<u8", len(raw) // 8).tolist()
                places, at, last = {}, 2, len(words) - 1
                while at < last and (number := words[at] & 0xFFFF):
                    places[number] = 8 * at + 16
                    at += 2 + (words[at + 1] + 7) // 8
                self.heaps[heap] = raw, places
            if heap != now:
                (raw, places), now = self.heaps[heap], heap
            place = places[index]
            out.append(raw[place : place + size])
        return out

    def value(self, kind: _Type, raw: bytes | np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
        """Elements of a type as numpy holds them."""
        flat = np.frombuffer(raw, kind.stored) if isinstance(raw, bytes) else raw
        if kind.kind == "text":
            own = np.empty(shape, object)
            own.ravel()[:] = self.texts(flat.ravel())
            return own
        return flat.reshape(shape).astype(bool) if kind.kind == "bool" else flat.reshape(shape)


def _shape_of(body: bytes) -> tuple[int, ...] | None:
    version, rank = body[0], body[1]
    if version == 2 and body[3] == 2:
        return None  # holds nothing
    return struct.unpack_from(f"<{rank}Q", body, 8 if version == 1 else 4)


def _attribute(source: _In, body: bytes) -> tuple[str, Any]:
    version = body[0]
    sizes, at = struct.unpack_from("<HHH", body, 2), 9 if version == 3 else 8
    parts = []
    for size in sizes:
        parts.append(body[at : at + size])
        at += (size + 7) // 8 * 8 if version == 1 else size
    name, (kind, _), shape = parts[0].rstrip(b"\0").decode(), _type_of(parts[1]), _shape_of(parts[2])
    if shape is None:
        return name, None
    value = source.value(kind, body[at : at + kind.size * int(np.prod(shape))], shape)
    if kind.kind == "text":
        text = np.vectorize(lambda x: x.decode(), otypes=[object])(value) if value.size else value
        return name, text if shape else text.item()
    return name, value if shape else value[()]


class _Node:
    """A group or dataset that is read."""

    def __init__(self, source: _In, place: int):
        self._source, self._place = source, place
        self._messages = source.messages(place)

    @property
    def attrs(self) -> dict[str, Any]:
        for number, body in self._messages:
            if number == _ATTRIBUTE_INFO and struct.unpack("<Q", body[2 + 2 * (body[1] & 1) :][:8])[0] != _UNDEFINED:
                raise OSError("attributes are stored in a heap, which can't be read")
        return dict(_attribute(self._source, body) for number, body in self._messages if number == _ATTRIBUTE)

    def _message(self, number: int) -> bytes | None:
        return next((body for n, body in self._messages if n == number), None)


class Dataset(_Node):
    def __init__(self, source: _In, place: int):
        super().__init__(source, place)
        self.shape = _shape_of(self._message(_SPACE))
        described = self._message(_TYPE)
        self._type = _type_of(described)[0] if described else _Type(0)

    @property
    def dtype(self) -> np.dtype:
        return self._type.dtype

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, at: Any) -> Any:
        if self.shape is None or not self._type.size or self._type.kind == "other":
            raise TypeError("a dataset of this type can't be read")
        if not self.shape:
            return self._source.value(self._type, self._rows(0, 1), ())[()]
        if isinstance(at, tuple) and len(at) == 2 and at[0] == slice(None) and self._message(_LAYOUT)[1] == 1:
            return self._columns(at[1])
        first = at if isinstance(at, slice) else slice(None)
        start, stop, step = first.indices(self.shape[0])
        stop = max(start, stop)
        out = self._source.value(self._type, self._rows(start, stop), (stop - start, *self.shape[1:]))
        return out[::step] if isinstance(at, slice) or at == () else out[at]

    def _columns(self, cut: slice) -> np.ndarray:
        """Columns of a contiguous matrix; only they are read."""
        a, b, step = cut.indices(self.shape[1])
        place, size = struct.unpack_from("<Q", self._message(_LAYOUT), 2)[0], self._type.size
        b = max(a, b)
        rows = [bytes((b - a) * size) if place == _UNDEFINED else self._source.read(place + (i * self.shape[1] + a) * size, (b - a) * size) for i in range(self.shape[0])]
        return self._source.value(self._type, b"".join(rows), (self.shape[0], b - a))[:, ::step]

    def _rows(self, a: int, b: int) -> bytes | np.ndarray:
        """Stored elements of rows [a, b)."""
        layout, each = self._message(_LAYOUT), self._type.size * int(np.prod(self.shape[1:], dtype=np.int64))
        if layout[0] not in (3, 4):
            raise OSError("unknown layout of a dataset")
        if layout[1] == 0:
            return layout[4 + a * each : 4 + b * each]
        if layout[1] == 1:
            place = struct.unpack_from("<Q", layout, 2)[0]
            return bytes((b - a) * each) if place == _UNDEFINED else self._source.read(place + a * each, (b - a) * each)
        if layout[0] == 4:
            raise OSError("chunks are indexed in a way that can't be read")
        rank = len(self.shape)
        tree, chunk = struct.unpack_from("<Q", layout, 3)[0], struct.unpack_from(f"<{rank}I", layout, 11)
        out = np.zeros((b - a, *self.shape[1:]), self._type.stored)
        key = 8 + 8 * (rank + 1)
        first = lambda k: struct.unpack_from("<Q", k, 8)[0]
        for low, place in self._source.leaves(tree, key, 1, lambda low, high: first(low) < b and first(high) + chunk[0] > a):
            size, mask = struct.unpack_from("<II", low)
            at = struct.unpack_from(f"<{rank}Q", low, 8)
            if at[0] >= b or at[0] + chunk[0] <= a:
                continue
            block = np.frombuffer(self._unfiltered(self._source.read(place, size), mask), self._type.stored, int(np.prod(chunk))).reshape(chunk)
            into = tuple(slice(max(0, o - s), min(n, o - s + c)) for o, c, s, n in zip(at, chunk, (a, *[0] * (rank - 1)), out.shape, strict=True))
            taken = tuple(slice(max(0, s - o), max(0, s - o) + t.stop - t.start) for o, s, t in zip(at, (a, *[0] * (rank - 1)), into, strict=True))
            out[into] = block[taken]
        return out

    def _unfiltered(self, raw: bytes, mask: int) -> bytes:
        body = self._message(_FILTERS)
        if body is None:
            return raw
        steps, at = [], 8 if body[0] == 1 else 2
        for k in range(body[1]):
            number = struct.unpack_from("<H", body, at)[0]
            named = body[0] == 1 or number >= 256
            length = struct.unpack_from("<H", body, at + 2)[0] if named else 0
            _, values = struct.unpack_from("<HH", body, at + (4 if named else 2))
            at += (8 if named else 6) + ((length + 7) // 8 * 8 if body[0] == 1 else length)
            at += 4 * (values + (values % 2 if body[0] == 1 else 0))
            if not mask >> k & 1:
                steps.append(number)
        for number in reversed(steps):
            if number == _DEFLATE:
                raw = zlib.decompress(raw)
            elif number == _SHUFFLE:
                size, whole = self._type.size, len(raw) // self._type.size * self._type.size
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(size, -1).T.tobytes() + raw[whole:]
            elif number == _CHECKSUM:
                raw = raw[:-4]
            else:
                raise OSError(f"filter {number} of a dataset can't be undone")
        return raw


class Group(_Node):
    def __init__(self, source: _In, place: int):
        super().__init__(source, place)
        self._links: dict[str, int] = {}
        for number, body in self._messages:
            if number == _TABLE:
                self._links |= dict(source.links(*struct.unpack("<QQ", body[:16])))
            elif number == _LINK:
                flags, at = body[1], 2 + (8 if body[1] & 4 else 0) + (1 if body[1] & 16 else 0)
                hard = not (flags & 8 and body[2])
                at += 1 if flags & 8 else 0
                width = 1 << (flags & 3)
                size = int.from_bytes(body[at : at + width], "little")
                at += width
                if hard:
                    self._links[body[at : at + size].decode()] = struct.unpack_from("<Q", body, at + size)[0]
            elif number == _LINK_INFO and struct.unpack("<Q", body[2 + 8 * (body[1] & 1) :][:8])[0] != _UNDEFINED:
                raise OSError("links are stored in a heap, which can't be read")

    def _find(self, path: str) -> _Node | None:
        now: _Node = self
        for part in path.strip("/").split("/"):
            if not isinstance(now, Group) or part not in now._links:
                return None
            place = now._links[part]
            now = Dataset(self._source, place) if any(n == _LAYOUT for n, _ in self._source.messages(place)) else Group(self._source, place)
        return now

    def keys(self) -> list[str]:
        return sorted(self._links)

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __contains__(self, path: str) -> bool:
        return self._find(path) is not None

    def __getitem__(self, path: str) -> Any:
        if (found := self._find(path)) is None:
            raise KeyError(path)
        return found

    def get(self, path: str, default: Any = None) -> Any:
        found = self._find(path)
        return default if found is None else found


class _Out:
    """A file that is written: bytes go to its end, each on a multiple of eight."""

    def __init__(self, path: str):
        self.f, self.end, self.heap = open(path, "wb"), 0, None
        self.put(bytes(96))

    def put(self, raw: bytes) -> int:
        place = self.end
        self.f.write(_padded(raw))
        self.end += (len(raw) + 7) // 8 * 8
        return place

    def texts(self, size: np.ndarray, raw: bytes) -> np.ndarray:
        """References to strings, of these sizes one after the other, which are gathered in collections of 64 KiB or of one longer string."""
        out, flat = np.zeros(len(size), _REFERENCE), np.frombuffer(raw, np.uint8)
        out["size"] = size
        need = 16 + (size + 7) // 8 * 8
        ends, taken = np.cumsum(need), np.cumsum(size)
        k = 0
        while k < len(size):
            h = self.heap
            if h is None or h["free"] < need[k] + 16 or h["n"] == 60_000:
                self.flush()
                whole = max(1 << 16, 32 + int(need[k]))
                h = self.heap = {"place": self.put(bytes(whole)), "size": whole, "free": whole - 16, "n": 0, "parts": []}
            before, skip = (int(ends[k - 1]), int(taken[k - 1])) if k else (0, 0)
            stop = min(int(np.searchsorted(ends, before + h["free"] - 16, "right")), k + 60_000 - h["n"])  # as many as there is room for
            own, number, starts = size[k:stop], np.arange(h["n"] + 1, h["n"] + 1 + stop - k), ends[k:stop] - need[k:stop] - before
            block = np.zeros(int(ends[stop - 1]) - before, np.uint8)
            words = block.view("<u8")
            words[starts // 8], words[starts // 8 + 1] = number, own
            block[np.repeat(starts + 16 - (taken[k:stop] - own - skip), own) + np.arange(int(taken[stop - 1]) - skip)] = flat[skip : int(taken[stop - 1])]
            out["heap"][k:stop], out["index"][k:stop] = h["place"], number
            h["parts"].append(block.tobytes())
            h["n"] += stop - k
            h["free"] -= len(block)
            k = stop
        return out

    def flush(self) -> None:
        if (h := self.heap) is not None:
            self.f.seek(h["place"])
            self.f.write(b"GCOL" + struct.pack("<B3xQ", 1, h["size"]) + b"".join(h["parts"]) + struct.pack("<HH4xQ", 0, 0, h["free"]))
            self.f.seek(self.end)
            self.heap = None

    def stored(self, values: np.ndarray) -> bytes:
        """The bytes of an array as they lie in the file."""
        if values.dtype == _REFERENCE:
            return values.tobytes()
        if values.dtype.kind == "O":
            own = [x if isinstance(x, bytes) else str(x).encode() for x in values.ravel().tolist()]
            return self.texts(np.fromiter(map(len, own), np.int64, len(own)), b"".join(own)).tobytes()
        order = values.dtype.newbyteorder("<")
        return np.ascontiguousarray(values, order).tobytes()

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", number, len(_padded(raw)), number == _TYPE) + _padded(raw) for number, raw in messages)
        if any(len(raw) > 65_000 for _, raw in messages):
            raise OSError("an attribute is too long for this format")
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def tree(self, kind: int, fan: int, key: int, entries: list[tuple[bytes, int]], last: bytes) -> int:
        """A B-tree over (lower key, child), with the key that ends the last child; returns the root."""
        level, size = 0, 24 + (fan + 1) * key + fan * 8
        while True:
            nodes = [entries[i : i + fan] for i in range(0, len(entries), fan)] or [[]]
            places = [self.end + i * ((size + 7) // 8 * 8) for i in range(len(nodes))]
            for i, own in enumerate(nodes):
                end = nodes[i + 1][0][0] if i + 1 < len(nodes) else last
                sides = (places[i - 1] if i else _UNDEFINED, places[i + 1] if i + 1 < len(nodes) else _UNDEFINED)
                raw = b"TREE" + struct.pack("<BBHQQ", kind, level, len(own), *sides) + b"".join(k + struct.pack("<Q", child) for k, child in own) + (end if own else b"")
                self.put(raw.ljust(size, b"\0"))
            if len(nodes) == 1:
                return places[0]
            entries, level = [(own[0][0], place) for own, place in zip(nodes, places, strict=True)], level + 1


def _space(shape: tuple[int, ...], grows: bool = False) -> bytes:
    more = struct.pack(f"<{len(shape)}Q", *[_UNDEFINED, *shape[1:]]) if grows else b""
    return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), grows, *shape) + more


class _New:
    """What groups and datasets that are written share: attributes."""

    def __init__(self, out: _Out):
        self._out, self.attrs = out, {}

    def _attributes(self) -> list[tuple[int, bytes]]:
        messages = []
        for name, value in self.attrs.items():
            own = np.asarray(value, object if isinstance(value, str) or np.asarray(value).dtype.kind in "U" else None)
            parts = (name.encode() + b"\0", _described(own.dtype), _space(own.shape))
            messages.append((_ATTRIBUTE, struct.pack("<BxHHH", 1, *map(len, parts)) + b"".join(map(_padded, parts)) + self._out.stored(own)))
        return messages


class NewDataset(_New):
    """A dataset that is written at once, or one that grows along its first axis by whole rows."""

    def __init__(self, out: _Out, shape: tuple[int, ...], dtype: np.dtype, chunk: int = 0, compression: str | None = None):
        super().__init__(out)
        self.shape, self.dtype, self._chunk, self._deflated = shape, dtype, chunk, compression is not None
        self._size = 16 if dtype.kind == "O" else max(1, dtype.itemsize)
        self._held, self._n, self._chunks, self._place = [], 0, [], _UNDEFINED

    def __len__(self) -> int:
        return self.shape[0]

    def resize(self, shape: tuple[int, ...]) -> None:
        self.shape = tuple(shape)

    def __setitem__(self, at: slice, values: Any) -> None:
        if at.start != self._n:
            raise ValueError("rows can only be added at the end")
        self._add(np.asarray(values, self.dtype))

    def add_texts(self, size: np.ndarray, raw: bytes) -> None:
        """Adds strings, of these sizes one after the other."""
        self._add(self._out.texts(size, raw))

    def _add(self, own: np.ndarray) -> None:
        self._n += len(own)
        if not self._chunk:  # contiguous: nothing else may be written before the last row
            place = self._out.put(self._out.stored(own))
            if self._place == _UNDEFINED:
                self._place = place
            elif place != self._place + (self._n - len(own)) * self._size * int(np.prod(self.shape[1:], dtype=np.int64)):
                raise ValueError("rows of a contiguous dataset must follow each other")
            return
        self._held.append(own)
        if sum(map(len, self._held)) >= self._chunk:
            whole = np.concatenate(self._held)
            full = len(whole) // self._chunk * self._chunk
            for at_ in range(0, full, self._chunk):
                self._write(whole[at_ : at_ + self._chunk])
            self._held = [whole[full:].copy()]

    def _write(self, block: np.ndarray) -> None:
        raw = self._out.stored(block).ljust(self._chunk * self._size * int(np.prod(self.shape[1:], dtype=np.int64)), b"\0")
        raw = zlib.compress(raw, 4) if self._deflated else raw
        self._chunks.append((len(raw), self._out.put(raw)))

    def _close(self) -> int:
        messages = [(_SPACE, _space(self.shape, bool(self._chunk))), (_TYPE, _described(self.dtype)), (_FILL, struct.pack("<BBBBI", 2, 3 if self._chunk else 2, 2, 1, 0))]
        if self._chunk:
            if sum(map(len, self._held)):
                self._write(np.concatenate(self._held))
            rank = len(self.shape)
            key = lambda size, at: struct.pack(f"<II{rank + 1}Q", size, 0, at * self._chunk, *[0] * rank)
            entries = [(key(size, k), place) for k, (size, place) in enumerate(self._chunks)]
            tree = self._out.tree(1, _CHUNK_FAN, 8 + 8 * (rank + 1), entries, key(0, len(entries))) if entries else _UNDEFINED
            messages.append((_LAYOUT, struct.pack(f"<BBBQ{rank}II", 3, 2, rank + 1, tree, self._chunk, *self.shape[1:], self._size)))
            if self._deflated:
                messages.append((_FILTERS, struct.pack("<BB6xHHHH8sI4x", 1, 1, _DEFLATE, 8, 1, 1, b"deflate", 4)))
        else:
            size = self._size * int(np.prod(self.shape, dtype=np.int64))
            messages.append((_LAYOUT, struct.pack("<BBQQ", 3, 1, self._place if size else _UNDEFINED, size)))
        return self._out.header([*messages, *self._attributes()])


class NewGroup(_New):
    def __init__(self, out: _Out):
        super().__init__(out)
        self._items: dict[str, NewGroup | NewDataset] = {}

    def keys(self) -> list[str]:
        return sorted(self._items)

    def __contains__(self, path: str) -> bool:
        now: Any = self
        for part in path.split("/"):
            now = now._items.get(part) if isinstance(now, NewGroup) else None
        return now is not None

    def require_group(self, path: str) -> NewGroup:
        now = self
        for part in path.split("/"):
            now = now._items.setdefault(part, NewGroup(self._out))
        return now

    def create_group(self, path: str) -> NewGroup:
        found = self.require_group(path)
        if found._items:
            raise ValueError(f"{path} exists")
        return found

    def create_dataset(self, path: str, data: Any = None, shape: tuple[int, ...] | None = None, dtype: Any = None, maxshape: Any = None, chunks: tuple[int, ...] | None = None, compression: str | None = None) -> NewDataset:
        top, _, name = path.rpartition("/")
        if data is None:
            made = NewDataset(self._out, tuple(shape), np.dtype(dtype), chunks[0] if chunks else 0, compression)
        else:
            own = np.asarray(data, object if isinstance(data, (str, bytes)) else dtype)
            own = own.astype(object) if own.dtype.kind == "U" else own
            made = NewDataset(self._out, own.shape, own.dtype)
            made._place = self._out.put(self._out.stored(own)) if own.size else _UNDEFINED
        (self.require_group(top) if top else self)._items[name] = made
        return made

    def _close(self) -> tuple[int, int, int]:
        """Writes what the group holds; returns its header, B-tree and heap."""
        out, entries, heap = self._out, [], bytearray(8)
        for name in sorted(self._items, key=str.encode):
            item = self._items[name]
            header = item._close()
            entries.append((len(heap), header[0] if isinstance(item, NewGroup) else header))
            heap += _padded(name.encode() + b"\0")
        children, low = [], 0
        for i in range(0, len(entries), _LEAF):
            own = entries[i : i + _LEAF]
            raw = b"SNOD" + struct.pack("<BxH", 1, len(own)) + b"".join(struct.pack("<QQ24x", *e) for e in own)
            children.append((struct.pack("<Q", low), out.put(raw.ljust(8 + 40 * _LEAF, b"\0"))))
            low = own[-1][0]
        tree = out.tree(0, _GROUP_FAN, 8, children, struct.pack("<Q", low))
        data = out.put(bytes(heap))
        place = out.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, data))
        return out.header([(_TABLE, struct.pack("<QQ", tree, place)), *self._attributes()]), tree, place


class _NewFile(NewGroup):
    """The root of a file that is written beside its place and moved there when it is complete."""

    def __init__(self, path: str):
        self._path = path
        super().__init__(_Out(f"{path}.part"))

    def __enter__(self) -> _NewFile:
        return self

    def __exit__(self, error: Any, *_: Any) -> None:
        out = self._out
        if error is None:
            header, tree, heap = self._close()
            out.flush()
            out.f.seek(0)
            out.f.write(_SIGNATURE + struct.pack("<8BHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, _LEAF // 2, _GROUP_FAN // 2, 0, 0, _UNDEFINED, out.end, _UNDEFINED) + struct.pack("<QQI4xQQ", 0, header, 1, tree, heap))
        out.f.close()
        if error is None:
            os.replace(f"{self._path}.part", self._path)
        else:
            os.remove(f"{self._path}.part")


class _OldFile(Group):
    def __init__(self, path: str):
        source = _In(path)
        super().__init__(source, source.root)

    def __enter__(self) -> _OldFile:
        return self

    def __exit__(self, *_: Any) -> None:
        os.close(self._source.fd)


def File(path: str, mode: str = "r") -> Any:  # noqa: N802
    return _OldFile(path) if mode == "r" else _NewFile(path)
