"""Members of zip files, bounded decompression and NumPy headers."""

from __future__ import annotations

import ast
import bz2
import lzma
import re
import struct
import zipfile
import zlib
from io import BytesIO

MEMBER_LIMIT = 10 << 20
#: Longer members are read to the end unless they are packed more tightly than this.
MOST_PACKED = 50
LIMIT = 16 << 20
MOST_MEMBERS = 512
CUT = "member_cut"


def _inflate(raw: bytes, method: int, limit: int) -> bytes | None:
    if method == zipfile.ZIP_STORED:
        return raw[:limit]
    if method == zipfile.ZIP_DEFLATED:
        try:
            return zlib.decompressobj(-15).decompress(raw, limit)
        except zlib.error:
            return None
    return None


def local_members(data: bytes, most: int = MOST_MEMBERS) -> list[tuple[str, bytes | None]]:
    """Members by their local headers, for a zip file without a directory; what more there is has the name ""."""
    out, at = [], data.find(b"PK\x03\x04")
    while at != -1 and at + 30 <= len(data):
        if len(out) == most:
            return [*out, ("", None)]
        flags, method = struct.unpack_from("<HH", data, at + 6)
        size, name_size, extra = struct.unpack_from("<I4xHH", data, at + 18)
        body = at + 30 + name_size + extra
        end = body + size if size and not flags & 8 else len(data)
        got = _inflate(data[body:end], method, MEMBER_LIMIT)
        if got is not None:
            out.append((data[at + 30 : at + 30 + name_size].decode("utf-8", "replace"), got))
        at = data.find(b"PK\x03\x04", max(body, at + 4))
    return out


def _file(data):
    """The bytes as a file; a mapped file is one."""
    return BytesIO(data) if isinstance(data, (bytes, bytearray)) else data


def members(data: bytes, limit: int = MEMBER_LIMIT, most: int = MOST_MEMBERS, wanted: str = ""):
    """(name, bytes or None, note) of each member; checksums and header names that disagree do not hide a member.

    Members whose names do not end in `wanted` are not read. One that is longer than `limit` and packed more tightly than
    MOST_PACKED ends there, with the note CUT. More members than `most` end with one row ("", None, "members_capped").
    """
    try:
        z = zipfile.ZipFile(_file(data))
    except Exception:
        for name, got in local_members(data):
            if got is None:
                yield "", None, "members_capped"
            elif name.endswith(wanted):
                yield name, got, CUT if len(got) >= MEMBER_LIMIT else "recovered"
        return
    for i, info in enumerate(x for x in z.infolist() if x.filename.endswith(wanted)):
        if i == most:
            yield "", None, "members_capped"
            return
        try:
            with z.open(info) as f:
                own = max(limit, MOST_PACKED * info.compress_size)
                body = f.read(own)
                more = f.read(1)
            yield info.filename, body, CUT if more else None
        except Exception as problem:
            at = info.header_offset
            got, own = None, max(limit, MOST_PACKED * info.compress_size)
            if data[at : at + 4] == b"PK\x03\x04":
                name_size, extra = struct.unpack_from("<HH", data, at + 26)
                body = at + 30 + name_size + extra
                got = _inflate(data[body : body + info.compress_size], info.compress_type, own)
            yield info.filename, got, CUT if got is not None and len(got) >= own else f"raw read: {type(problem).__name__}"


def is_zip(data: bytes) -> bool:
    return zipfile.is_zipfile(_file(data))


def compression_of(data: bytes) -> tuple[str | None, bool]:
    from bracken.functions.containers import COMPRESSIONS

    for label, (magic, readable) in COMPRESSIONS.items():
        if data[: len(magic) // 2] == bytes.fromhex(magic):
            return label, readable
    if len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib", True
    return None, False


def decompress(data: bytes, label: str, limit: int = LIMIT) -> tuple[bytes, bool]:
    """(payload of at most limit bytes, whether it is whole); damaged bytes give what came before the damage."""
    if label in ("gzip", "zlib"):
        codec = zlib.decompressobj(31 if label == "gzip" else 15)
    elif label == "bz2":
        codec = bz2.BZ2Decompressor()
    else:
        codec = lzma.LZMADecompressor(lzma.FORMAT_ALONE if label == "lzma" else lzma.FORMAT_XZ)
    out = bytearray()
    try:
        for at in range(0, len(data), 1 << 16):
            out += codec.decompress(data[at : at + (1 << 16)], limit - len(out) if limit > len(out) else 1)
            if codec.eof or len(out) >= limit:
                break
        while not codec.eof and len(out) < limit:
            more = codec.decompress(codec.unconsumed_tail, limit - len(out)) if label in ("gzip", "zlib") else codec.decompress(b"", limit - len(out))
            if not more:
                break
            out += more
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return bytes(out[:limit]), False
    return bytes(out[:limit]), codec.eof


def old_joblib(data: bytes, limit: int = LIMIT) -> tuple[bytes, bool] | None:
    """The payload of a file that starts with ZF, a length and zlib data."""
    head = re.match(rb"ZF(0x[0-9a-fA-F]+|\d+)\s*", data[:40])
    if not head:
        return None
    return decompress(data[head.end() :], "zlib", limit)


def _has_objects(descr: object) -> bool:
    """Whether a dtype description holds objects, by its format places alone."""
    if isinstance(descr, str):
        return "O" in descr
    if isinstance(descr, tuple):
        return bool(descr) and _has_objects(descr[0])
    if isinstance(descr, list):
        return any(isinstance(f, tuple) and len(f) > 1 and _has_objects(f[1]) for f in descr)
    return False


def npy(data: bytes) -> dict | None:
    """version, dtype, shape, object_dtype and offset of a NumPy file's header; None for other bytes."""
    if data[:6] != b"\x93NUMPY" or len(data) < 12:
        return None
    wide = data[6] >= 2
    size = int.from_bytes(data[8 : 12 if wide else 10], "little")
    at = 12 if wide else 10
    text = data[at : at + min(size, 1 << 20)].decode("latin-1")
    out = {"version": f"{data[6]}.{data[7]}", "dtype": None, "shape": None, "object_dtype": False, "offset": at + size}
    try:
        head = ast.literal_eval(text.strip())
        out |= {"dtype": str(head["descr"]), "shape": str(head["shape"]), "object_dtype": _has_objects(head["descr"])}
    except Exception:
        got = re.search(r"'descr'\s*:\s*'([^']*)'", text)
        if got:
            out |= {"dtype": got[1], "object_dtype": "O" in got[1]}
    return out
