"""Model files to facts (one Arrow pass over the bytes), then facts to verdicts (columns only).

Input: DataFrame with `path` and `content`, and perhaps `cut` and `sha256`: a file whose content is cut is read from its
path, mapped, to its end; if that cannot be done, it is marked incomplete, and no incomplete file is LOW. Null content gives a row with `error`; empty content is read like any other.
Files that no extension and no content claims are left out. Equal files give equal rows; further columns are not carried.
"""

from __future__ import annotations

import contextlib
import hashlib
import mmap

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bracken.functions import rules, targets, templates, verdicts
from bracken.sources import archives, models, pickles

SCHEMA = (
    "path string, name string, inspector string, framework string, sha256 string, license string, container string, note string, "
    "imports array<struct<module:string,name:string,args:array<string>,via:string,pos:bigint>>, incomplete boolean, unreadable string, carries_pickle boolean, member_unread boolean, is_text boolean, "
    "findings array<string>, lambda_layers array<string>, templates array<struct<key:string,body:string>>, keys_read bigint, keys_total bigint, truncated boolean, "
    "custom_ops array<string>, external array<string>, tensors bigint, dtypes array<string>, lint array<struct<offset:bigint,severity:string,message:string,hint:string>>, error string, "
    "dill boolean, packed string, unpacked_bytes bigint, npy struct<version:string,dtype:string,object_dtype:boolean,shape:string>, members bigint, header_keys array<string>, "
    "architecture string, quantization bigint, metadata_keys array<string>, layer_count bigint, keras_version string, "
    "onnx struct<ir_version:bigint,producer_name:string,producer_version:string,graph_name:string,opsets:array<string>,nodes:bigint,op_types:array<string>,subgraphs:bigint>"
)
_NAMES = {"safetensors": "SafeTensors", "gguf": "GGUF", "keras": "Keras", "onnx": "ONNX", "pytorch": "PyTorch"}


def _extension(name: str) -> str:
    return name[name.rfind(".") :].lower() if "." in name[1:] else ""


def _route(name: str, data: bytes) -> str | None:
    from bracken.functions.containers import REQUIREMENTS, ROUTES

    if name == REQUIREMENTS:
        return "requirements"
    for inspector, extensions in ROUTES.items():
        if _extension(name) in extensions.split():
            return inspector
    return "variant" if pickles.head_is_pickle(data)[0] else None


def _rows(found: list[pickles.Import]) -> list[dict]:
    return [g._asdict() for g in found]


def _text_like(data: bytes) -> bool:
    try:
        text = data[:1024].decode()
    except UnicodeDecodeError as problem:
        if problem.start < len(data[:1024]) - 3:
            return False
        text = data[: problem.start].decode()
    return bool(text) and sum(c.isprintable() or c in "\r\n\t" for c in text) > 0.9 * len(text)


def _container(data: bytes) -> str | None:
    from bracken.functions.containers import CONTAINERS

    return next((n for n, magic in CONTAINERS.items() if data[: len(magic) // 2] == bytes.fromhex(magic)), None)


def _pytorch(data: bytes, out: dict, every_member: bool) -> None:
    if not archives.is_zip(data):
        out["container"] = _container(data)
        if out["container"]:
            return
        found, out["incomplete"], _ = pickles.facts(data)
        out["imports"], out["carries_pickle"] = _rows(found), pickles.is_pickle(data)
        out["is_text"], out["lint"] = _text_like(data), pickles.lint(data)
        return
    out["container"] = "zip"
    held = False
    for name, body, note in archives.members(data, wanted=".pkl"):
        if held and not every_member:
            break
        held = True
        out["members"] = (out["members"] or 0) + 1
        out["note"] = note or out["note"]
        out["incomplete"] |= note == archives.CUT
        if body is None:
            out["member_unread"] = True
            continue
        found, cut, _ = pickles.facts(body)
        out["imports"] += _rows(found)
        out["incomplete"] |= cut
        out["lint"] += pickles.lint(body)
    out["carries_pickle"] = held


def _variant(data: bytes, out: dict) -> None:
    def look(body: bytes, whole: bool = True) -> None:
        head = archives.npy(body)
        out["dill"] = out["dill"] or b"_create_code" in body
        if head:
            out["framework"] = "NumPy"
            out["npy"] = out["npy"] or {k: head[k] for k in ("version", "dtype", "object_dtype", "shape")}
            out["dtypes"] = sorted({*out["dtypes"], str(head["dtype"])})
            body = body[head["offset"] :]
        found, cut, _ = pickles.facts(body)
        out["imports"] += _rows(found)
        out["incomplete"] |= cut or not whole
        out["carries_pickle"] |= bool(found) or bool(head and head["object_dtype"]) or pickles.is_pickle(body)

    if archives.is_zip(data):
        out["container"] = "zip"
        out["members"] = 0
        for name, body, note in archives.members(data):
            out["members"] += 1
            if body is None:
                out["incomplete"] = True
            else:
                look(body, note != archives.CUT)
            out["note"] = note or out["note"]
        return
    old = archives.old_joblib(data)
    label, readable = ("zlib", True) if old else archives.compression_of(data)
    out["container"] = label
    out["packed"] = label
    if label and not readable:
        out["unreadable"] = label
    elif label:
        body, whole = old or archives.decompress(data, label)
        out["unpacked_bytes"] = len(body)
        look(body, whole)
    else:
        look(data)
        out["lint"] = pickles.lint(data)


def _keras(data: bytes, out: dict) -> None:
    import json

    config = None
    if archives.is_zip(data):
        out["container"] = "zip"
        for name, body, note in archives.members(data, wanted=".json"):
            if name not in ("config.json", "metadata.json") or body is None:
                continue
            out["incomplete"] |= note == archives.CUT
            try:
                got = json.loads(body)
            except (ValueError, RecursionError):
                got = None
            if name == "config.json":
                config = got
                out["findings"] += models.keras_bytes_threats(body) if got is None else []
            elif isinstance(got, dict):
                out["keras_version"] = got.get("keras_version")
    elif models.hdf5_at(data) is not None:
        out["container"], config, out["keras_version"] = "hdf5", models.hdf5_config(data), models.hdf5_version(data)
    if isinstance(config, dict):
        inner = config.get("config")
        layers = inner.get("layers") if isinstance(inner, dict) else None
        out["layer_count"] = len(layers) if isinstance(layers, list) else None
        out["keras_version"] = out["keras_version"] or config.get("keras_version")
    if config is not None:
        out["findings"] += models.keras_threats(config)
    elif not out["findings"]:
        out["findings"] += models.keras_bytes_threats(data)
        out["truncated"] = True
    out["lambda_layers"] = [t.partition(": ")[2] for t in out["findings"] if t.startswith("KERAS_LAMBDA: ")]


def _gguf(data: bytes, out: dict) -> None:
    got = models.gguf(data)
    if got is None:
        out["error"] = "Invalid Header"
        return
    out["keys_read"], out["keys_total"], out["truncated"] = got["read"], got["total"], got["truncated"]
    texts = {k: v for k, kind, v in got["entries"] if kind == models.GGUF_STRING}
    out["license"] = texts.get("general.license") or texts.get("license")
    out["architecture"] = texts.get("general.architecture") or next((v for k, v in texts.items() if "architecture" in k), None)
    values = {k: v for k, _, v in got["entries"]}
    out["quantization"] = next((int(v) for k, v in values.items() if ("file_type" in k or "quantization" in k) and isinstance(v, int)), None)
    out["metadata_keys"] = [k for k, _, _ in got["entries"]]
    out["templates"] = [{"key": k, "body": texts[k]} for k in sorted(texts) if texts[k] and (k == "tokenizer.chat_template" or k.startswith("tokenizer.chat_template."))]


def _onnx(data: bytes, out: dict) -> None:
    got = models.onnx(data)
    if not got["parsed"]:
        out["error"] = "Unparsable ONNX"
    out["truncated"], out["external"] = got["truncated"], list(dict.fromkeys(got["external"]))
    out["custom_ops"] = list(dict.fromkeys(f"{d}.{op}" for d, op in got["nodes"] if d not in models.STANDARD_DOMAINS))
    about = {k: got[k] for k in ("ir_version", "producer_name", "producer_version", "graph_name", "subgraphs")}
    out["onnx"] = about | {"opsets": [f"{d or 'ai.onnx'}:{v}" for d, v in got["opsets"]], "nodes": len(got["nodes"]), "op_types": list(dict.fromkeys(op for _, op in got["nodes"]))}


def _mapped(path: str):
    """The whole file, mapped; None if it cannot be."""
    try:
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    except (OSError, ValueError):
        return None


def look(path: str, data: bytes | None, every_member: bool = False, cut: bool = False, sha256: str | None = None) -> dict | None:
    """The facts of one file; None if nothing claims it. cut: `data` is but the beginning of the file at `path`."""
    whole = _mapped(path) if cut else None
    try:
        out = _look(path, data if whole is None else whole, every_member, cut and whole is None)
    except Exception as problem:  # a hostile file must not end the scan of others
        out = _blank(path) | {"inspector": "unknown", "error": f"{type(problem).__name__}", "incomplete": True}
    finally:
        if whole is not None:
            with contextlib.suppress(BufferError):  # a part that is still held: the map goes with it
                whole.close()
    if out is not None and cut and out["inspector"]:
        out["sha256"] = sha256 or (out["sha256"] if whole is not None else None)
    return out


def _blank(path: str) -> dict:
    out: dict = dict.fromkeys(x.strip().split(" ")[0] for x in _columns())
    out |= {k: [] for k in ("imports", "findings", "lambda_layers", "templates", "custom_ops", "external", "dtypes", "lint")}
    out |= {k: False for k in ("incomplete", "carries_pickle", "member_unread", "is_text", "truncated", "dill")}
    return out | {"path": path, "name": path.replace("\\", "/").rsplit("/", 1)[-1]}


def _fitting(value: object, kind: pa.DataType) -> object:
    """The value as a column of that type holds it: lone surrogates escaped, numbers beyond 64 bits at their bounds."""
    if value is None:
        return None
    if pa.types.is_list(kind):
        return [_fitting(v, kind.value_type) for v in value] if isinstance(value, list) else None
    if pa.types.is_struct(kind):
        return {f.name: _fitting(value.get(f.name), f.type) for f in kind} if isinstance(value, dict) else None
    if pa.types.is_string(kind):
        return str(value).encode("utf-8", "backslashreplace").decode()
    if pa.types.is_boolean(kind):
        return bool(value)
    return max(-(1 << 63), min((1 << 63) - 1, value)) if isinstance(value, int) else None


def _look(path: str, data: bytes | None, every_member: bool, cut: bool) -> dict | None:
    out = _blank(path)
    name = out["name"]
    if data is None:
        return out | {"error": "unreadable"}
    kind = _route(name, data)
    if kind is None and cut and pickles.head_is_pickle(data)[1]:
        kind = "variant"  # the rest of the file might show a pickle
    if kind in (None, "requirements"):  # the latter belong to the dependencies
        return None
    out |= {"inspector": kind, "sha256": hashlib.sha256(data).hexdigest(), "framework": _NAMES.get(kind)}
    if kind == "pytorch":
        _pytorch(data, out, every_member)
    elif kind == "variant":
        out["framework"] = {".joblib": "Joblib", ".npy": "NumPy", ".npz": "NumPy"}.get(_extension(name), "Pickle")
        _variant(data, out)
    elif kind == "safetensors":
        got = models.safetensors(data)
        out |= {"tensors": got["tensors"], "dtypes": got["dtypes"], "license": got["license"], "header_keys": got["header_keys"]} if got else {"error": "Invalid Header"}
    elif kind in ("gguf", "keras", "onnx"):
        {"gguf": _gguf, "keras": _keras, "onnx": _onnx}[kind](data, out)
    out["incomplete"] |= cut
    out["lint"] = [{"offset": a, "severity": b, "message": c, "hint": d} for a, b, c, d in out["lint"]]
    return out


def _columns() -> list[str]:
    depth, out, start = 0, [], 0
    for i, c in enumerate(SCHEMA):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(SCHEMA[start:i])
            start = i + 1
    return [*out, SCHEMA[start:]]


def facts(files: DataFrame, every_member: bool = False) -> DataFrame:
    """Facts of each claimed file. One file is looked at a time, so memory follows the largest file, not the batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        for batch in batches:
            got = [look(p.as_py() or "", c.as_py(), every_member, bool(k.as_py()), s.as_py()) for p, c, k, s in zip(*batch.columns)]
            got = [{f.name: _fitting(g[f.name], f.type) for f in schema} for g in got if g is not None]
            if got:
                yield pa.RecordBatch.from_pylist(got, schema=schema)

    more = [F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("cut", "boolean"), ("sha256", "string"))]
    return files.select("path", "content", *more).mapInArrow(run, SCHEMA)


def dependencies(files: DataFrame) -> DataFrame:
    """(name, version) of the lines of requirements files."""
    from bracken.functions.containers import route
    from bracken.sources.files import requirement

    lines = files.where(route(F.col("path")) == "requirements").select(F.explode(F.split(F.decode("content", "UTF-8"), r"\r\n|\r|\n")).alias("line"))
    return lines.select(requirement(F.col("line")).alias("r")).where("r IS NOT NULL").select("r.*")


def _named(prefix: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(prefix), x))


def _onnx_threats() -> Column:
    def one(location: Column) -> Column:
        return F.concat(F.when(targets.path_escapes(location), "ONNX_EXTERNAL_DATA_ESCAPE: ").otherwise("ONNX_EXTERNAL_DATA: "), location)

    return F.concat(F.transform("external", one), _named("ONNX_CUSTOM_OP: ", F.col("custom_ops")))


def _count(items: Column, prefix: str) -> Column:
    return F.size(F.filter(items, lambda t: t.startswith(prefix)))


def _parts(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "; ")


def keras_label(threats: Column, layers: Column) -> Column:
    names = F.array_distinct(layers)
    code, callables = _count(threats, "KERAS_MARSHALLED_CODE: "), _count(threats, "KERAS_SERIALIZED_LAMBDA: ")
    detail = _parts(
        F.when(F.size(names) > 0, F.concat(F.lit("Lambda layer(s): "), F.array_join(names, ", "))),
        F.when(code > 0, F.concat(code.cast("string"), F.lit(" embedded code object(s)"))),
        F.when((callables > 0) & (F.size(names) == 0), F.concat(callables.cast("string"), F.lit(" serialized callable(s)"))),
    )
    return F.concat(F.lit("CRITICAL (Keras Lambda Code Execution — "), F.when(detail == "", F.array_join(threats, "; ")).otherwise(detail), F.lit(")"))


def onnx_label(threats: Column, truncated: Column) -> Column:
    head = "ONNX_EXTERNAL_DATA_ESCAPE: "
    outside = F.transform(F.filter(threats, lambda t: t.startswith(head)), lambda t: F.substring(t, len(head) + 1, 1 << 20))
    custom, external = _count(threats, "ONNX_CUSTOM_OP: "), _count(threats, "ONNX_EXTERNAL_DATA: ")
    some = _parts(F.when(custom > 0, F.concat(custom.cast("string"), F.lit(" custom operator(s)"))), F.when(external > 0, F.concat(external.cast("string"), F.lit(" external tensor(s)"))))
    return F.when(F.size(outside) > 0, F.concat(F.lit("CRITICAL (ONNX External Data Escapes Model Directory: "), F.array_join(outside, ", "), F.lit(")"))).when(some != "", F.concat(F.lit("MEDIUM (ONNX: "), some, F.lit(")"))).when(truncated, "MEDIUM (ONNX graph incomplete: depth limit reached)").otherwise("LOW")


def judge(found: DataFrame, strict: bool = False) -> DataFrame:
    """Adds threats, risk_level and legal_status to facts."""
    kind = F.col("inspector")
    many = F.size("templates") > 1
    from_templates = F.flatten(F.transform("templates", lambda t: F.transform(templates.threats(t["body"]), lambda x: F.when(many, F.concat(F.lit("["), t["key"], F.lit("] "), x)).otherwise(x))))
    threats = F.when(kind.isin("pytorch", "variant"), rules.threats(F.col("imports"), F.lit(strict))).when(kind == "gguf", F.array_distinct(from_templates)).when(kind == "onnx", _onnx_threats()).otherwise(F.col("findings"))
    rows = found.withColumn("threats", threats)
    t, size = F.col("threats"), F.size("threats")
    rce = F.concat(F.lit("CRITICAL (RCE Detected: "), F.array_join(t, ", "), F.lit(")"))
    base = F.when(size > 0, rce)
    zipped = base.when(F.col("incomplete"), "MEDIUM (Pickle Scan Incomplete)").when(F.col("member_unread"), "MEDIUM (Unreadable Pickle Member)").when(F.col("carries_pickle"), "MEDIUM (Pickle Present)").otherwise("LOW")
    bare = F.when(F.col("container").isNotNull(), F.concat(F.lit("CRITICAL (Non-Standard Container: "), F.col("container"), F.lit(")"))).otherwise(
        base.when(F.col("incomplete"), "MEDIUM (Pickle Scan Incomplete)").when(F.col("carries_pickle"), "MEDIUM (Pickle Present)").when(F.col("is_text"), "LOW").otherwise("CRITICAL (Legacy Binary)")
    )
    variant = base.when(F.col("incomplete"), "MEDIUM (Pickle Scan Incomplete)").when(F.col("unreadable").isNotNull(), F.concat(F.lit("MEDIUM (Unscanned Container: "), F.col("unreadable"), F.lit(")"))).when(F.col("carries_pickle"), "MEDIUM (Pickle Present)").otherwise("LOW")
    risk = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("UNKNOWN ("), F.col("error"), F.lit(")")))
        .when(kind == "pytorch", F.when(F.col("container") == "zip", zipped).otherwise(bare))
        .when(kind == "variant", variant)
        .when(kind == "gguf", templates.risk_label(t, F.col("truncated"), F.col("keys_read"), F.col("keys_total")))
        .when(kind == "keras", F.when(size > 0, keras_label(t, F.col("lambda_layers"))).when(F.col("truncated"), "MEDIUM (Keras config incomplete: read limit reached)").otherwise("LOW"))
        .when(kind == "onnx", onnx_label(t, F.col("truncated")))
        .otherwise("LOW")
    )
    risk = F.when(F.col("incomplete") & (risk == "LOW"), "MEDIUM (Scan Incomplete)").otherwise(risk)
    return rows.withColumn("risk_level", risk).withColumn("legal_status", verdicts.legal_status("license"))


def scan(files: DataFrame, strict: bool = False) -> DataFrame:
    return judge(facts(files), strict)


def classify(artifacts: DataFrame, case: str, malicious: str) -> DataFrame:
    """(case, verdict): detected, partial or missed of a malicious case, clean or false-positive of others."""
    named = F.bool_or(F.col("risk_level").contains("RCE Detected") | F.col("risk_level").contains("UNSAFE_IMPORT"))
    flagged = F.bool_or(F.col("risk_level").startswith("CRITICAL") | F.col("risk_level").startswith("MEDIUM"))
    bad = F.bool_or(malicious)
    verdict = F.when(~bad, F.when(named, "false-positive").otherwise("clean")).when(named, "detected").when(flagged, "partial").otherwise("missed")
    return artifacts.groupBy(case).agg(verdict.alias("verdict"))
