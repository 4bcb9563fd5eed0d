"""Formation plans and knowledge files: TOML (plain or zstd) and the tables made from them."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN_SCHEMA = "name string, top double, base double, lithology string, hardness double, pore_pressure double, fracture_gradient double, hazards array<string>, wob struct<min: double, optimal: double, max: double>, rpm struct<min: double, optimal: double, max: double>, flow struct<min: double, optimal: double, max: double>, mud_weight double"


def load_plan(spark: SparkSession, path: str | Path) -> DataFrame:
    """A well's formation plan (a small TOML file, read on the driver), sorted by top."""
    table = tomllib.loads(Path(path).read_text())
    span = lambda p, k: tuple(float(p.get(k, {}).get(x, 0.0)) for x in ("min", "optimal", "max"))
    rows = []
    for f in table.get("formations", []):
        p = f.get("parameters", {})
        rows.append((f["name"], float(f["depth_top_ft"]), float(f["depth_base_ft"]), f.get("lithology", ""), float(f.get("hardness", 5.0)), float(f.get("pore_pressure_ppg", 0.0)), float(f.get("fracture_gradient_ppg", 0.0)), list(f.get("hazards", [])), span(p, "wob_klbs"), span(p, "rpm"), span(p, "flow_gpm"), float(p.get("mud_weight_ppg", 0.0))))
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), PLAN_SCHEMA)


def read_toml_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``body`` (JSON) of many TOML files, ``.zst`` ones unpacked; broken files have a NULL body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import zstandard

        def body(name: str, raw: bytes) -> str | None:
            try:
                text = zstandard.ZstdDecompressor().decompressobj().decompress(raw) if name.endswith(".zst") else raw
                return json.dumps(tomllib.loads(text.decode()), default=str)
            except (tomllib.TOMLDecodeError, UnicodeDecodeError, zstandard.ZstdError):
                return None

        for b in batches:
            yield pd.DataFrame({"file": b["path"], "body": [body(n, bytes(c)) for n, c in zip(b["path"], b["content"], strict=True)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, body string")


def safe_name(name: Column) -> Column:
    """Names as files carry them: blanks as underscores, no slashes or brackets."""
    return F.regexp_replace(F.regexp_replace(name, " ", "_"), r"[/\\()]", "")
