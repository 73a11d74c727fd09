"""CEF lines. Lines that are not CEF give no row (they are rejects)."""

from __future__ import annotations

import sys
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.severity import CEF_SEVERITY, lookup
from sieveline.functions.text import kv_map
from sieveline.sources.common import record, run_one

# --- fixed values (line shape and extension rule of the original tool) --------
# Header: CEF:version|vendor|product|device_version|signature_id|name|severity|extension
CEF_HEADER = r"^CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
# Extension pair: a value runs until the next " key=" and never ends in "=".
CEF_EXTENSION = r"(?U)(\w+)=((?:[^=](?!(?:\s\w+=)))*[^=]?)"
# ------------------------------------------------------------------------------

_SEP = "\u0000"
_HEADER_KEYS = ["cef_version", "vendor", "product", "device_version", "signature_id"]


def stages(on: Column, **_) -> list[dict[str, Column]]:
    line = F.col("line")
    joined = F.regexp_replace(line, CEF_HEADER, _SEP.join(f"${i}" for i in range(1, 9)))
    hdr = F.when(on & line.rlike(CEF_HEADER), F.split(joined, _SEP, 8))
    return [{"cef_h": hdr},
            {"cef_ext": F.when(F.col("cef_h").isNotNull(), kv_map(F.col("cef_h")[7], CEF_EXTENSION))}]


def fields(on: Column, **_) -> Column:
    h = lambda i: F.col("cef_h")[i]
    ext = lambda k: F.nullif(F.try_element_at(F.col("cef_ext"), F.lit(k)), F.lit(""))
    ts_raw = F.coalesce(ext("rt"), ext("end"), ext("start"))
    header_map = F.create_map(*[x for i, k in enumerate(_HEADER_KEYS) for x in (F.lit(k), h(i))])
    rec = record(
        F.coalesce(ext("src"), ext("shost"), F.concat(h(1), F.lit("/"), h(2))),
        F.coalesce(ext("dhost"), ext("shost"), F.lit("")),
        h(5),
        F.map_concat(header_map, F.col("cef_ext")),
        ts_text=ts_raw, severity=lookup(CEF_SEVERITY, F.trim(h(6))), guess_text=h(6),
    )
    return F.when(on & F.col("cef_h").isNotNull(), rec)


def normalize_cef(lines: DataFrame, ingested_at: datetime | None = None) -> DataFrame:
    return run_one(lines, sys.modules[__name__], "cef", ingested_at=ingested_at)
