"""Inventories as CycloneDX and SPDX documents, component properties and Markdown rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from bracken.functions import containers, descriptions
from bracken.operators import ranking

PREFIX = "bracken:"
#: Operators of a model that its inventory names.
MOST_OPERATORS = 200


def properties(judged: DataFrame) -> DataFrame:
    """(path, pos, name, value) of what is known of each artifact; nulls are left out, lists of findings repeat a name."""
    fmt = containers.framework_format(F.col("framework"))

    def one(name: str, value: Column) -> Column:
        return F.struct(F.lit(PREFIX + name).alias("name"), value.cast("string").alias("value"))

    def csv(values: Column) -> Column:
        return F.when(F.size(values) > 0, F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), ","))

    def many(name: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(PREFIX + name).alias("name"), v.alias("value")))

    known = fmt.isNotNull()
    bears = known & F.col("inspector").isin("pytorch", "variant")
    of = lambda f, value: F.when(fmt == f, value)
    threats = F.coalesce("threats", F.array().cast("array<string>"))
    templates = F.col("templates")
    about = F.concat(F.array(one("risk", F.col("risk_level")), one("legal", F.col("legal_status")), one("format", fmt)))
    pickled = F.concat(
        many("pickle:opcode", F.when(bears, threats)),
        F.array(
            one("pickle:opcode_count", F.when(bears, F.size(threats))),
            one("pickle:container", F.when(bears & (F.col("inspector") == "variant"), F.coalesce("container", F.when(F.col("npy").isNotNull(), "npy").otherwise("bare")))),
            one("pickle:scan_incomplete", F.when(bears & F.col("incomplete"), "true")),
            one("pickle:dill_code_objects", F.when(bears & F.col("dill"), "true")),
            one("joblib:compression", of("joblib", F.col("packed"))),
            one("joblib:decompressed_bytes", of("joblib", F.col("unpacked_bytes"))),
            one("numpy:dtype", of("numpy", F.col("npy.dtype"))),
            one("numpy:object_dtype", of("numpy", F.col("npy.object_dtype"))),
            one("numpy:shape", of("numpy", F.col("npy.shape"))),
            one("numpy:npy_version", of("numpy", F.col("npy.version"))),
            one("numpy:member_count", of("numpy", F.col("members"))),
        ),
    )
    headers = F.array(
        one("safetensors:tensor_count", of("safetensors", F.col("tensors"))),
        one("safetensors:dtypes", of("safetensors", csv(F.col("dtypes")))),
        one("safetensors:header_keys", of("safetensors", csv(F.col("header_keys")))),
        one("gguf:architecture", of("gguf", F.col("architecture"))),
        one("gguf:quantization", of("gguf", F.col("quantization"))),
        one("gguf:metadata_keys", of("gguf", csv(F.col("metadata_keys")))),
        one("gguf:chat_template", of("gguf", F.when(F.size(templates) > 0, "present"))),
        one("gguf:chat_template_length", of("gguf", F.when(F.size(templates) > 0, F.aggregate(templates, F.lit(0), lambda n, t: n + F.char_length(t["body"]))))),
        one("gguf:chat_template_sha256", of("gguf", F.when(F.size(templates) > 0, F.sha2(F.try_element_at(templates, F.lit(1))["body"].cast("binary"), 256)))),
    )
    gguf = F.concat(many("gguf:chat_template_threat", of("gguf", threats)), F.array(one("gguf:chat_template_threat_count", of("gguf", F.when(F.size(templates) > 0, F.size(threats))))))
    keras = F.concat(
        F.array(one("keras:container", of("keras", F.col("container")))),
        many("keras:threat", of("keras", threats)),
        F.array(
            one("keras:threat_count", of("keras", F.size(threats))),
            one("keras:lambda_layers", of("keras", csv(F.col("lambda_layers")))),
            one("keras:layer_count", of("keras", F.col("layer_count"))),
            one("keras:version", of("keras", F.col("keras_version"))),
        ),
    )
    onnx = F.concat(
        F.array(*[one(f"onnx:{k}", of("onnx", F.nullif(F.col(f"onnx.{k}").cast("string"), F.lit("")))) for k in ("ir_version", "producer_name", "producer_version", "graph_name")]),
        F.array(
            one("onnx:opsets", of("onnx", csv(F.col("onnx.opsets")))),
            one("onnx:node_count", of("onnx", F.col("onnx.nodes"))),
            one("onnx:op_types", of("onnx", csv(F.slice("onnx.op_types", 1, MOST_OPERATORS)))),
            one("onnx:custom_ops", of("onnx", csv(F.col("custom_ops")))),
            one("onnx:custom_op_count", of("onnx", F.size("custom_ops"))),
        ),
        many("onnx:external_data_location", of("onnx", F.filter("external", lambda x: x != ""))),
        F.array(one("onnx:external_data_count", of("onnx", F.size("external")))),
        many("onnx:threat", of("onnx", threats)),
    )
    rows = F.filter(F.concat(about, pickled, headers, gguf, keras, onnx), lambda p: p["value"].isNotNull())
    return judged.select("path", F.posexplode(rows).alias("pos", "p")).select("path", "pos", "p.name", "p.value")


def components(judged: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """(name, type, version, description, sha256) of artifacts and libraries."""
    text = descriptions.build(F.col("risk_level"), F.coalesce("framework", F.lit("Unknown")), F.col("legal_status"), F.coalesce("license", F.lit("Unknown")))
    rows = judged.select("name", F.lit("machine-learning-model").alias("type"), F.lit(None).cast("string").alias("version"), text.alias("description"), containers.sha256_or_null(F.col("sha256")).alias("sha256"))
    if dependencies is None:
        return rows
    return rows.unionByName(dependencies.select("name", F.lit("library").alias("type"), "version"), allowMissingColumns=True)


def cyclonedx_rows(parts: DataFrame) -> DataFrame:
    """One JSON component a row; fields without a value are left out."""
    hashes = F.when(F.col("sha256").isNotNull(), F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("sha256").alias("content"))))
    return parts.select(F.to_json(F.struct("type", "name", "version", "description", hashes.alias("hashes"))).alias("component"))


def spdx_rows(parts: DataFrame, order: list[str]) -> DataFrame:
    """(spdx_id, package): one JSON package a row, its id unique."""
    checks = F.when(F.col("sha256").isNotNull(), F.array(F.struct(F.lit("SHA256").alias("algorithm"), F.col("sha256").alias("checksumValue"))))
    rows = ranking.identifiers(parts, order).withColumn("spdx_id", F.concat(F.lit("SPDXRef-"), F.col("spdx_id")))
    package = F.struct(F.col("spdx_id").alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.col("description").alias("comment"), checks.alias("checksums"))
    return rows.select("spdx_id", F.to_json(package).alias("package"))


def cyclonedx(parts: DataFrame, version: str = "1.6") -> str:
    """The whole document, in memory: for one scan's inventory. Larger ones keep `cyclonedx_rows`."""
    rows = sorted(r.component for r in cyclonedx_rows(parts).toLocalIterator())
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": version, "version": 1, "components": [json.loads(r) for r in rows]}, indent=2)


def spdx(parts: DataFrame, order: list[str], created: str) -> str:
    """The whole SPDX 2.3 document, in memory; without packages it describes NONE."""
    rows = sorted((r.spdx_id, r.package) for r in spdx_rows(parts, order).toLocalIterator())
    described = [i for i, _ in rows] or ["NONE"]
    about = {"spdxVersion": "SPDX-2.3", "dataLicense": "CC0-1.0", "SPDXID": "SPDXRef-DOCUMENT", "name": "scan", "documentNamespace": f"urn:bracken:{created}", "creationInfo": {"created": created, "creators": ["Tool: bracken"]}}
    links = [{"spdxElementId": "SPDXRef-DOCUMENT", "relationshipType": "DESCRIBES", "relatedSpdxElement": i} for i in described]
    return json.dumps(about | {"packages": [json.loads(p) for _, p in rows], "relationships": links}, indent=2)
