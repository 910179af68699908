"""The HDF5 file module: what it writes it reads, and the layouts of other writers, put together here byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from annomat.sources import h5file


def test_known_bytes():
    """Descriptions of types and the head of a file, as the format's specification and common files have them."""
    assert h5file._described(np.dtype("<f8")).hex(" ") == "11 20 3f 00 08 00 00 00 00 00 40 00 34 0b 00 34 ff 03 00 00"
    assert h5file._described(np.dtype("<f4")).hex(" ") == "11 20 1f 00 04 00 00 00 00 00 20 00 17 08 00 17 7f 00 00 00"
    assert h5file._described(np.dtype("<i4")).hex(" ") == "10 08 00 00 04 00 00 00 00 00 20 00"
    assert h5file._described(np.dtype("u1")).hex(" ") == "10 00 00 00 01 00 00 00 00 00 08 00"
    assert h5file._described(np.dtype(object)).hex(" ") == "19 01 01 00 10 00 00 00 10 00 00 00 01 00 00 00 00 00 08 00"
    assert h5file._space((3, 4)).hex(" ") == "01 02 00 00 00 00 00 00 03 00 00 00 00 00 00 00 04 00 00 00 00 00 00 00"


@pytest.mark.parametrize("value", [
    np.arange(5, dtype="i1"), np.arange(6, dtype="<f4").reshape(2, 3), np.array([True, False]), np.float64(3.5), np.zeros(3, "<c8"), np.array([b"ab", b"c"]), np.zeros(0),
    np.asarray(["é", "", "x" * 200_000], object), np.arange(4, dtype=">u2"), np.zeros((0, 3)), np.int32(7),
])
def test_values(tmp_path, value):
    path = str(tmp_path / "a.h5")
    with h5file.File(path, "w") as f:
        f.create_dataset("a/b/c", data=value)
        f.create_group("g").attrs["v"] = value
    with h5file.File(path) as f:
        got, attribute = f["a/b/c"][()], f["g"].attrs["v"]
        if value.dtype.kind == "O":
            assert [x.decode() for x in got.tolist()] == value.tolist() == attribute.tolist()
        else:
            assert np.array_equal(got, value) and np.array_equal(attribute, value) and f["a/b/c"].shape == value.shape
        assert "a/b/x" not in f and "a/b/c/d" not in f and f.get("z", 5) == 5 and list(f) == ["a", "g"]
        with pytest.raises(KeyError):
            f["nothing"]


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_growing(tmp_path, compression):
    """Hundreds of chunks, so that their index has levels, added in steps that fit no chunk."""
    path, rng = str(tmp_path / "a.h5"), np.random.default_rng(1)
    numbers, block = rng.integers(0, 1 << 40, 50_000), rng.normal(size=(3000, 7))
    texts = [f"t{i}é" * (i % 5) for i in range(5000)]
    with h5file.File(path, "w") as f:
        for name, own, kind, chunk, more in (("n", numbers, "<i8", 30, (None,)), ("m", block, "<f8", 11, (None, 7)), ("t", np.asarray(texts, object), h5file.string_dtype(), 100, (None,))):
            d = f.create_dataset(name, shape=(0, *more[1:]), maxshape=more, dtype=kind, chunks=(chunk, *more[1:]), compression=compression)
            for at in range(0, len(own), 777):
                d.resize((min(len(own), at + 777), *more[1:]))
                d[at:] = own[at : at + 777]
        f.create_dataset("none", shape=(0,), maxshape=(None,), dtype="<f4", chunks=(9,), compression=compression)
    with h5file.File(path) as f:
        assert np.array_equal(f["n"][()], numbers) and np.array_equal(f["n"][1234:4321], numbers[1234:4321]) and len(f["n"][7:3]) == 0
        assert np.array_equal(f["m"][()], block) and np.array_equal(f["m"][100:200], block[100:200]) and np.array_equal(f["m"][:, 2:5], block[:, 2:5])
        assert [x.decode() for x in f["t"][4000:].tolist()] == texts[4000:] and len(f["none"]) == 0


def test_many_names(tmp_path):
    path, names = str(tmp_path / "a.h5"), [f"name {k * 7919 % 3001}" for k in range(3000)]
    with h5file.File(path, "w") as f:
        for k, name in enumerate(names):
            f.create_dataset(f"g/{name}", data=np.int32(k))
    with h5file.File(path) as f:
        assert f["g"].keys() == sorted(names) and all(f["g"][name][()] == k for k, name in list(enumerate(names))[::97])


def test_columns_of_a_contiguous_matrix(tmp_path):
    path, m = str(tmp_path / "a.h5"), np.arange(40.0).reshape(4, 10)
    with h5file.File(path, "w") as f:
        f.create_dataset("m", data=m)
    with h5file.File(path) as f:
        assert np.array_equal(f["m"][:, 3:7], m[:, 3:7]) and np.array_equal(f["m"][1:3], m[1:3])


def test_failed_writes_leave_nothing(tmp_path):
    with pytest.raises(RuntimeError), h5file.File(str(tmp_path / "a.h5"), "w") as f:
        f.create_dataset("x", data=np.arange(3))
        raise RuntimeError
    assert list(tmp_path.iterdir()) == []
    (tmp_path / "b.h5").write_bytes(b"no such file" * 100)
    with pytest.raises(OSError):
        h5file.File(str(tmp_path / "b.h5"))


def test_newer_layout(tmp_path):
    """Superblock 2 behind a user block, version 2 headers with links and a continuation, shuffled, deflated and checked chunks."""
    out = bytearray()

    def put(raw: bytes) -> int:
        out.extend(raw)
        return len(out) - len(raw)

    def header(messages: list[tuple[int, bytes]], more: bytes = b"") -> bytes:
        body = b"".join(struct.pack("<BHB", n, len(raw), 0) + raw for n, raw in messages) + more
        return b"OHDR" + struct.pack("<BBH", 2, 1, len(body)) + body + bytes(4)

    put(bytes(48))
    values = np.arange(10, dtype="<i4")
    chunks = []
    for at in (0, 6):
        own = np.zeros(6, "<i4")
        own[: min(6, 10 - at)] = values[at : at + 6]
        raw = zlib.compress(own.view(np.uint8).reshape(6, 4).T.tobytes()) + b"sum!"
        chunks.append((at, len(raw), put(raw)))
    tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 0, 2, (1 << 64) - 1, (1 << 64) - 1) + b"".join(struct.pack("<IIQQQ", size, 0, at, 0, place) for at, size, place in chunks) + struct.pack("<IIQQ", 0, 0, 12, 0))
    filters = struct.pack("<BB", 2, 3) + b"".join(struct.pack("<HHH", n, 0, len(v)) + struct.pack(f"<{len(v)}I", *v) for n, v in ((2, (4,)), (1, (4,)), (3, ())))
    space, kind = struct.pack("<BBBBQ", 2, 1, 0, 1, 10), h5file._described(np.dtype("<i4"))
    data = put(header([(1, space), (3, kind), (8, struct.pack("<BBBQII", 3, 2, 2, tree, 6, 4)), (11, filters)]))
    note = struct.pack("<BBHHHB", 3, 0, 2, len(kind), 4, 0) + b"n\0" + kind + struct.pack("<BBBB", 2, 0, 0, 0) + struct.pack("<i", 41)
    link = lambda name, place: struct.pack("<BBB", 1, 0, len(name)) + name + struct.pack("<Q", place)
    extra = struct.pack("<BHB", 12, len(note), 0) + note
    later = put(b"OCHK" + extra + bytes(4))
    root = put(header([(2, struct.pack("<BBQQ", 0, 0, (1 << 64) - 1, (1 << 64) - 1)), (6, link(b"values", data)), (16, struct.pack("<QQ", later, len(extra) + 8))]))
    out[:48] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 512, (1 << 64) - 1, len(out), root) + bytes(4)
    (tmp_path / "n.h5").write_bytes(bytes(512) + bytes(out))
    with h5file.File(str(tmp_path / "n.h5")) as f:
        assert f.keys() == ["values"] and f.attrs == {"n": 41} and np.array_equal(f["values"][()], values) and np.array_equal(f["values"][5:8], [5, 6, 7])
