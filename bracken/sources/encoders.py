"""Writers of small model files, sound and tampered with, for round trips and for the labelled corpus. Nothing they write
does anything when it is read as bytes; what would be called is given a harmless text."""

from __future__ import annotations

import io
import json
import struct
import zipfile

from bracken.sources.models import GGUF_SCALARS, GGUF_STRING


def global_pickle(module: str, name: str, argument: str = "x") -> bytes:
    """Protocol 0: a GLOBAL by name, called with one text."""
    return f"c{module}\n{name}\n(S'{argument}'\ntR.".encode()


def stack_global_pickle(module: str, name: str, argument: str | None = "x") -> bytes:
    """Protocol 4: module and name as texts on the stack; without an argument it is called with none."""
    short = lambda s: b"\x8c" + bytes([len(s.encode())]) + s.encode() + b"\x94"
    given = b")" if argument is None else short(argument) + b"\x85"
    return b"\x80\x04" + short(module) + short(name) + b"\x93" + given + b"R."


def without_end(data: bytes, n: int = 1) -> bytes:
    return data[:-n] if n else data


def zipped(members: dict[str, bytes], packed: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED) as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
    return out.getvalue()


def torch_zip(stream: bytes, packed: bool = False) -> bytes:
    return zipped({"archive/data.pkl": stream, "archive/version": b"3"}, packed)


def _patched(data: bytes, at: int, new: bytes) -> bytes:
    return data[:at] + new + data[at + len(new) :]


def other_local_name(data: bytes, name: str, new: str) -> bytes:
    """The first local header names its member otherwise than the directory does."""
    if len(name) != len(new) or name.encode() not in data:
        raise ValueError(f"{new!r} cannot stand for {name!r}")
    return _patched(data, data.index(name.encode()), new.encode())


def local_flags(data: bytes, flags: int) -> bytes:
    """The first local header's flag bits."""
    return _patched(data, data.index(b"PK\x03\x04") + 6, struct.pack("<H", flags))


def wrong_crc(data: bytes) -> bytes:
    """The directory's checksum of its first member, made wrong."""
    at = data.index(b"PK\x01\x02") + 16
    return _patched(data, at, bytes([data[at] ^ 0xFF]))


def safetensors(tensors: dict[str, str], about: dict[str, str] | None = None) -> bytes:
    head = ({"__metadata__": about} if about else {}) | {k: {"dtype": d, "shape": [1], "data_offsets": [0, 0]} for k, d in tensors.items()}
    raw = json.dumps(head).encode()
    return struct.pack("<Q", len(raw)) + raw


def gguf(entries: list[tuple[str, int, object]], total: int | None = None) -> bytes:
    """entries: (key, type, value); an array's value is (element type, values)."""

    def text(s: str) -> bytes:
        return struct.pack("<Q", len(s.encode())) + s.encode()

    def value(kind: int, v) -> bytes:
        if kind in GGUF_SCALARS:
            return struct.pack(GGUF_SCALARS[kind], v)
        if kind == GGUF_STRING:
            return text(v)
        inner, items = v
        return struct.pack("<IQ", inner, len(items)) + b"".join(value(inner, x) for x in items)

    head = b"GGUF" + struct.pack("<IQQ", 3, 0, len(entries) if total is None else total)
    return head + b"".join(text(k) + struct.pack("<I", kind) + value(kind, v) for k, kind, v in entries)


def keras_zip(config: object, version: str | None = None) -> bytes:
    about = {"metadata.json": json.dumps({"keras_version": version}).encode()} if version else {}
    return zipped({"config.json": json.dumps(config).encode()} | about)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value: bytes | str | int) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    body = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(body)) + body


def onnx(nodes: list[tuple[str, str]], producer: str = "", external: list[str] = [], graph: str = "g", opsets: dict[str, int] | None = None, inside: int = 0) -> bytes:
    """nodes: (operator, domain). inside: how many graphs, each in a node of the one around it, hold the nodes."""
    body = b"".join(field(1, field(4, op) + field(7, domain)) for op, domain in nodes)
    body += b"".join(field(5, field(13, field(1, "location") + field(2, x)) + field(14, 1)) for x in external)
    for _ in range(inside):
        body = field(1, field(4, "If") + field(5, field(1, "then") + field(6, body)))
    sets = b"".join(field(8, field(1, d) + field(2, v)) for d, v in (opsets or {"": 17}).items())
    return field(1, 8) + field(2, producer) + field(3, "1.0") + field(7, body + field(2, graph)) + sets


def npy(descr: str, shape: str, body: bytes = b"") -> bytes:
    head = f"{{'descr': {descr}, 'fortran_order': False, 'shape': {shape}, }}".encode()
    head += b" " * (-(len(head) + 11) % 64) + b"\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head + body
