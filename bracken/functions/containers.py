"""Columns over file names and first bytes: routes, container magics, compression, fetch errors, marshalled code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The inspector of each extension.
ROUTES = {"pytorch": ".pt .pth .bin", "safetensors": ".safetensors", "gguf": ".gguf", "keras": ".keras .h5 .hdf5", "onnx": ".onnx", "variant": ".pkl .pickle .joblib .dill .npy .npz"}
REQUIREMENTS = "requirements.txt"
# First bytes (hex) of containers that a model file is not expected to be.
CONTAINERS = {"7z": "377ABCAF271C", "rar": "526172211A07", "xz": "FD377A585A00", "zstd": "28B52FFD", "bzip2": "425A68", "gzip": "1F8B", "lz4": "04224D18", "lzo": "894C5A4F"}
# First bytes of compressions, and whether they are opened.
COMPRESSIONS = {"gzip": ("1F8B", True), "bz2": ("425A68", True), "xz": ("FD377A585A00", True), "lzma": ("5D0000", True), "lz4": ("04224D18", False), "zstd": ("28B52FFD", False)}
FORMATS = {"PyTorch": "pickle", "SafeTensors": "safetensors", "GGUF": "gguf", "Keras": "keras", "ONNX": "onnx", "Pickle": "pickle", "Joblib": "joblib", "NumPy": "numpy"}


def _binary(hex_digits: str) -> Column:
    return F.unhex(F.lit(hex_digits))


def route(name: Column) -> Column:
    """The inspector of a file name, null if only its content can tell."""
    ext = F.lower(F.regexp_extract(name, r"[^/\\](\.[^./\\]+)$", 1))
    out = F.when(F.regexp_extract(name, r"([^/\\]*)$", 1) == REQUIREMENTS, "requirements")
    for inspector, extensions in ROUTES.items():
        out = out.when(ext.isin(extensions.split()), inspector)
    return out


def container(content: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, magic in CONTAINERS.items():
        out = out.when(F.startswith(content, _binary(magic)), name)
    return out


def zlib_header(content: Column) -> Column:
    """Whether the first two bytes make a zlib header."""
    first = F.conv(F.hex(F.substring(content, 1, 2)), 16, 10).cast("int")
    return F.coalesce((F.length(content) >= 2) & ((F.shiftright(first, 8) % 16) == 8) & (first % 31 == 0), F.lit(False))


def compression(content: Column) -> Column:
    """STRUCT<label, readable>; the label of bytes without compression is null."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("label"), F.lit(True).alias("readable")))
    for name, (magic, readable) in COMPRESSIONS.items():
        out = out.when(F.startswith(content, _binary(magic)), F.struct(F.lit(name).alias("label"), F.lit(readable).alias("readable")))
    return out.when(zlib_header(content), F.struct(F.lit("zlib").alias("label"), F.lit(True).alias("readable")))


def fetch_status(kind: Column, status: Column) -> Column:
    """The bucket of a failed fetch: its HTTP status, timeout, connection_error or other."""
    return F.when(kind == "http", F.coalesce(status.cast("string"), F.lit("other"))).when(kind == "timeout", "timeout").when(kind == "connection", "connection_error").otherwise("other")


def marshalled(value: Column) -> Column:
    """Whether a string is base64 of a marshalled code object, by its first bytes; it is not loaded."""
    tight = F.regexp_replace(value, r"(?U)\s+", "")
    raw = F.try_to_binary(tight, F.lit("base64"))
    shaped = tight.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.length(tight) >= 24) & (F.length(tight) % 4 == 0)
    header = F.substring(raw, 1, 1).isin(bytearray(b"\x63"), bytearray(b"\xe3")) & (F.substring(raw, 3, 3) == _binary("000000"))
    return F.coalesce(shaped & (F.length(raw) > 8) & header, F.lit(False))


def framework_format(framework: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])[framework]


def sha256_or_null(digest: Column) -> Column:
    """The lower-case digest; placeholders and other texts are null."""
    return F.when(digest.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lower(digest))
