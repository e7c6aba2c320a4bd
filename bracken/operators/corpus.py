"""A labelled corpus of evasions and its verdicts in both modes; the files are made here and only ever disassembled."""

from __future__ import annotations

import pickle
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from bracken.operators import inspect
from bracken.sources import encoders as e


class Case(NamedTuple):
    case_id: str
    title: str
    evasion_class: str
    malicious: bool
    name: str
    content: bytes
    limitation: str | None = None


def cases() -> list[Case]:
    system = e.global_pickle("os", "system")
    torch = e.torch_zip(system)
    # The ids of the published verdict matrix.
    return [
        Case("control-os-system-zip", "os.system in an ordinary zip", "control", True, "model.pt", torch),
        Case("benign-allowlisted-globals", "a plain state dict", "control", False, "model.pt", e.torch_zip(pickle.dumps({"state_dict": {"layer.weight": [0.1, 0.2]}}, 2))),
        Case("nullifai-7z-container", "7z in place of zip", "container-format", True, "model.pt", bytes.fromhex("377ABCAF271C") + system, "The archive is named but not opened, so the verdict does not come from what is inside."),
        Case("nullifai-broken-stream", "payload first, no end", "broken-stream", True, "model.pt", e.torch_zip(e.without_end(system))),
        Case("cve-2025-1716-pip-main", "pip.main", "unlisted-global", True, "model.pt", e.torch_zip(e.global_pickle("pip", "main"))),
        Case("cve-2025-1889-nonstandard-extension", "a pickle named config.p", "file-extension", True, "config.p", system),
        Case("cve-2025-1944-zip-filename-tamper", "local and directory names differ", "zip-tampering", True, "model.pt", e.other_local_name(torch, "archive/data.pkl", "archive/data_pkl")),
        Case("cve-2025-1945-zip-flag-bits", "flag bits changed", "zip-tampering", True, "model.pt", e.local_flags(torch, 8)),
        Case("cve-2025-10155-extension-confusion", "a bare pickle named model.bin", "file-extension", True, "model.bin", system),
        Case("cve-2025-10156-zip-crc", "wrong checksum", "zip-tampering", True, "model.pt", e.wrong_crc(torch)),
        Case("cve-2025-10157-asyncio-subclass", "a class of an asyncio submodule", "gadget-import", True, "model.pt", e.torch_zip(e.global_pickle("asyncio.unix_events", "_UnixSubprocessTransport"))),
        Case("checkmarx-bdb-gadget", "the debugger as a way to run code", "gadget-import", True, "model.pt", e.torch_zip(e.global_pickle("bdb", "Bdb"))),
        Case("shadowpickle-allowlist-overwrite", "an allowed builtin by STACK_GLOBAL", "allowlist-abuse", True, "model.pt", e.torch_zip(e.stack_global_pickle("collections", "OrderedDict")), "The call cannot be told from one in an ordinary checkpoint by its name alone."),
    ]


def table(spark) -> DataFrame:
    """pos, case_id, title, evasion_class, malicious, limitation, path and content of each case."""
    rows = [(i, c.case_id, c.title, c.evasion_class, c.malicious, c.limitation, f"{c.case_id}/{c.name}", bytearray(c.content)) for i, c in enumerate(cases())]
    return spark.createDataFrame(rows, "pos int, case_id string, title string, evasion_class string, malicious boolean, limitation string, path string, content binary")


def score(corpus: DataFrame) -> DataFrame:
    """(case_id, mode, verdict): every case in both modes. The bytes are read once for both."""
    facts = inspect.facts(corpus.select("path", "content"))
    out = None
    for mode in ("blocklist", "strict"):
        judged = inspect.judge(facts, mode == "strict").select("path", "risk_level")
        rows = corpus.select("case_id", "malicious", "path").join(judged, "path", "left").withColumn("risk_level", F.coalesce("risk_level", F.lit("")))
        verdicts = inspect.classify(rows, "case_id", "malicious").select("case_id", F.lit(mode).alias("mode"), "verdict")
        out = verdicts if out is None else out.unionByName(verdicts)
    return out
