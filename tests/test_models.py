"""Decoders against bytes made here, and whole scans of files in a folder."""

import bz2
import collections
import gzip
import io
import json
import lzma
import operator
import pickle
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import SparkSession, functions as F

from bracken.functions import rules, templates
from bracken.operators import documents, inspect, ranking
from bracken.sources import archives, files, models, pickles


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def call(module, name, arg="x"):
    """A protocol-4 pickle that would call module.name(arg)."""
    text = lambda s: b"\x8c" + bytes([len(s)]) + s.encode() + b"\x94"
    return b"\x80\x04" + text(module) + text(name) + b"\x93" + text(arg) + b"\x85R."


def pairs(data):
    return [(g.module, g.name) for g in pickles.facts(data)[0]]


def test_both_spellings_streams_and_salvage():
    assert pairs(b"cos\nsystem\n(S'x'\ntR.") == pairs(call("os", "system")) == [("os", "system")]
    assert pairs(b"N." * 200 + call("os", "system")) == [("os", "system")]
    assert pickles.facts(b"N." * 100, most_streams=10)[1] and not pickles.facts(b"N." * 100)[1]
    assert ("os", "system") in pairs(b"\xff\xff" + call("os", "system"))
    assert ("os", "system") in pairs(b"\xff\xffcos\nsystem\n")
    assert ("os", "system") in pairs(call("os", "system")[:-1])  # no end
    assert pickles.facts(b"") == ([], False, False)


def test_memo_reads_are_resolved():
    data = b"\x80\x04\x8c\x02os\x94\x8c\x01x\x940h\x00\x8c\x06system\x93."
    assert pairs(data) == [("os", "system")]


CLEAN = [operator.attrgetter("name"), operator.methodcaller("upper"), collections.OrderedDict(a=1), [1, {"k": (2, None)}]]
DUAL_USE = [operator.attrgetter("__class__.__mro__"), operator.methodcaller("system", "id")]


@pytest.mark.parametrize("strict", [False, True])
def test_ordinary_objects_are_clean_and_dual_use_arguments_count(spark, strict):
    made = [(f"{kind}{i}-{p}.pkl", pickle.dumps(v, p)) for kind, values in (("clean", CLEAN), ("dual", DUAL_USE)) for i, v in enumerate(values) for p in (2, 4)]
    got = inspect.scan(spark.createDataFrame(made, "path string, content binary"), strict).collect()
    assert len(got) == len(made) == 12
    for r in got:
        if r.name.startswith("clean"):
            assert r.threats == [] and r.risk_level == "MEDIUM (Pickle Present)"
        else:
            assert len(r.threats) == 1


def zipped(members, damage=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    raw = out.getvalue()
    return raw.replace(b"system", b"systeM", 1) if damage else raw


def gguf(entries, total=None):
    out = b"GGUF" + struct.pack("<IQQ", 3, 0, len(entries) if total is None else total)
    for key, kind, body in entries:
        out += struct.pack("<Q", len(key)) + key.encode() + struct.pack("<I", kind) + body
    return out


def text(s):
    return struct.pack("<Q", len(s)) + s.encode()


def field(n, body):
    if isinstance(body, int):
        return bytes([n << 3, body])
    return bytes([n << 3 | 2]) + bytes([len(body)]) + body


def onnx(domain="", location=None):
    node = field(4, b"Relu") + field(7, domain.encode())
    graph = field(1, node) + field(2, b"g")
    if location is not None:
        graph += field(5, field(13, field(1, b"location") + field(2, location.encode())) + field(14, 1))
    return field(1, 8) + field(7, graph)


TEMPLATE = "tokenizer.chat_template"
FILES = {
    "a.pt": (zipped({"m/data.pkl": call("os", "system")}), "CRITICAL (RCE Detected: os.system)"),
    "damaged.pt": (zipped({"m/data.pkl": call("os", "popen") + b"system"}, True), "CRITICAL (RCE Detected: os.popen)"),
    "packed.pt": (b"7z\xbc\xaf\x27\x1c123", "CRITICAL (Non-Standard Container: 7z)"),
    "old.pt": (b"\x00\x01\xfe\xff" * 9, "CRITICAL (Legacy Binary)"),
    "paths.pth": (b"/usr/lib/python\n", "LOW"),
    "b.joblib": (zlib.compress(call("os", "system")), "CRITICAL (RCE Detected: os.system)"),
    "c.joblib": (gzip.compress(pickle.dumps([1])), "MEDIUM (Pickle Present)"),
    "d.joblib": (bz2.compress(call("os", "system")), "CRITICAL (RCE Detected: os.system)"),
    "e.joblib": (lzma.compress(call("os", "system")), "CRITICAL (RCE Detected: os.system)"),
    "f.joblib": (b"\x28\xb5\x2f\xfd00", "MEDIUM (Unscanned Container: zstd)"),
    "half.joblib": (zlib.compress(pickle.dumps(list(range(9))) * 9)[:-6], "MEDIUM (Pickle Scan Incomplete)"),
    ".hidden": (call("os", "system"), "CRITICAL (RCE Detected: os.system)"),
    "empty.pkl": (b"", "LOW"),
    "g.safetensors": (struct.pack("<Q", 2) + b"{}", "LOW"),
    "h.safetensors": (b"\xff" * 9, "UNKNOWN (Invalid Header)"),
    "i.gguf": (gguf([("n", 0, b"\1"), ("a", 9, struct.pack("<IQ", 5, 2) + bytes(8)), (TEMPLATE, 8, text("{{ x.__class__ }}"))]), "CRITICAL (Chat Template Code Execution: __class__)"),
    "j.gguf": (gguf([(TEMPLATE, 8, text("{% include 'x' %}"))]), "MEDIUM (Chat Template: 1 anomalous construct(s))"),
    "k.gguf": (gguf([("n", 0, b"\1")], 3), "MEDIUM (GGUF metadata incomplete: 1/3 keys read)"),
    "l.keras": (zipped({"config.json": json.dumps({"class_name": "Lambda", "config": {"name": "L"}})}), "CRITICAL (Keras Lambda Code Execution — Lambda layer(s): L)"),
    "m.onnx": (onnx(), "LOW"),
    "n.onnx": (onnx("own"), "MEDIUM (ONNX: 1 custom operator(s))"),
    "o.onnx": (onnx("", "w.bin"), "MEDIUM (ONNX: 1 external tensor(s))"),
    "p.onnx": (onnx("", "../w.bin"), "CRITICAL (ONNX External Data Escapes Model Directory: ../w.bin)"),
    "q.npy": (b"\x93NUMPY\x01\x00\x40\x00" + b"{'descr': '<f8', 'fortran_order': False, 'shape': (0,), }".ljust(64), "LOW"),
    "r.npy": (b"\x93NUMPY\x01\x00\x40\x00" + b"{'descr': '|O', 'fortran_order': False, 'shape': (1,), }".ljust(64) + call("os", "system"), "CRITICAL (RCE Detected: os.system)"),
}


def test_scan_of_a_folder(spark, tmp_path):
    for name, (body, _) in FILES.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "README.md").write_text("nothing to see")
    (tmp_path / "style.dat").write_bytes(b".")
    rows = inspect.scan(files.artifact_files(spark, str(tmp_path)))
    got = {r.name: r.risk_level for r in rows.collect()}
    assert got == {name: risk for name, (_, risk) in FILES.items()}
    parts = documents.components(rows)
    assert len(json.loads(documents.cyclonedx(parts))["components"]) == len(FILES)
    spdx = json.loads(documents.spdx(parts, ["name"], "2024-01-01T00:00:00Z"))
    assert len({p["SPDXID"] for p in spdx["packages"]}) == len(FILES)
    empty = json.loads(documents.spdx(parts.limit(0), ["name"], "2024-01-01T00:00:00Z"))
    assert empty["relationships"][0]["relatedSpdxElement"] == "NONE"


def test_null_content_and_no_files(spark):
    rows = spark.createDataFrame([("a.pt", None)], "path string, content binary")
    assert inspect.scan(rows).first().risk_level == "UNKNOWN (unreadable)"
    assert inspect.scan(rows.limit(0)).count() == 0


def test_zip_without_directory():
    whole = zipped({"data.pkl": call("os", "system")})
    cut = whole[: whole.index(b"PK\x01\x02")]
    assert [n for n, body, _ in archives.members(cut) if body] == ["data.pkl"]


@pytest.mark.parametrize("line,want", [("torch==2.1.0", ("torch", "2.1.0")), ("requests>=2.0,<3", ("requests", "2.0")), ("numpy", ("numpy", "unknown")), ("x[extra] == 1 ; python_version<'4'", ("x", "1")), ("# note", None), ("", None), (None, None)])
def test_requirements(spark, line, want):
    got = spark.createDataFrame([(line,)], "l string").select(files.requirement(F.col("l"))).first()[0]
    assert (tuple(got) if got else None) == want


def test_identifiers_are_unique_where_suffixes_meet_names(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-2"), (4, "y z"), (5, "y z")], "k int, name string")
    got = {r.k: r.spdx_id for r in ranking.identifiers(rows, ["k"]).collect()}
    assert got == {1: "x", 2: "x-2", 3: "x-2-2", 4: "y-z", 5: "y-z-2"}


def test_long_literals_and_cut_templates(spark):
    df = spark.createDataFrame([("{{ '" + "a" * 200_000 + "' }}",), ("{{ '" + "b" * 600_000,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(templates.threats(F.col("t"))).collect()]
    assert got[0] == [] and got[1][0].startswith(templates.CUT) and not got[2] and got[3] == []


def test_ancestors_and_lint(spark):
    assert spark.range(1).select(rules.ancestors(F.lit("a.b.c"))).first()[0] == ["a.b.c", "a.b", "a"]
    assert [s for _, s, *_ in pickles.lint(call("own.thing", "T"))] == ["ERROR", "WARNING"]
    assert pickles.lint(b"\xff\xff") == []


def test_top_with_overflow(spark):
    rows = spark.createDataFrame([(f"n{i}", "LOW", "", "f") for i in range(12)], "name string, severity string, issue string, framework string")
    got = [r.line for r in ranking.top_with_overflow(rows, 10).orderBy("pos").collect()]
    assert len(got) == 11 and "+ 2 more" in got[-1]


def test_protobuf_of_hostile_bytes():
    assert list(models.fields(b"\x0a\xff\x01ab"))[0][2] == b"ab"
    assert list(models.fields(b"\x00\x01")) == []
    assert models.gguf(gguf([("a", 9, struct.pack("<IQ", 8, 1 << 40))]))["truncated"]


def test_files_above_the_read_limit(spark, tmp_path):
    import hashlib
    import os

    pad = os.urandom(17 << 20)
    late = b"\x80\x04B" + struct.pack("<I", len(pad)) + pad + b"0" + call("os", "system")[2:]
    with zipfile.ZipFile(tmp_path / "big.pt", "w") as z:
        z.writestr("archive/data/0", pad)
        z.writestr("archive/data.pkl", call("os", "system"))
    with zipfile.ZipFile(tmp_path / "late.pt", "w") as z:
        z.writestr("archive/data.pkl", late)
    for name in ("late.pkl", "late.unclaimed"):
        (tmp_path / name).write_bytes(late)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in inspect.scan(files.artifact_files(spark, str(tmp_path))).collect()}
    assert len(rows) == 4
    for name, r in rows.items():
        assert "RCE Detected" in r.risk_level and r.sha256 == hashlib.sha256((tmp_path / name).read_bytes()).hexdigest(), name
    gone = inspect.look("/nowhere/late.pkl", late[: 16 << 20], cut=True, sha256="x")
    assert gone["incomplete"] and gone["sha256"] == "x"
    with zipfile.ZipFile(tmp_path / "bomb.pt", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data.pkl", b"\x80\x04B" + struct.pack("<I", 24 << 20) + bytes(24 << 20) + b"0" + call("os", "system")[2:])
    assert inspect.look("bomb.pt", (tmp_path / "bomb.pt").read_bytes())["incomplete"]
