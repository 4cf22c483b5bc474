"""Sinks: CSV tables, JSON summary and evidence, Markdown report, audit pack. What they collect is one row a method, domain or pair."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import tarfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import formats
from plumbline.sources import files


def atomic_write(path: str | Path, data: bytes) -> None:
    files.write_bytes(str(path), data)


def write_json(path: str | Path, obj: object) -> None:
    atomic_write(path, json.dumps(obj, indent=2, default=str).encode())


def append_jsonl(path: str | Path, row: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(row) + "\n")


def write_csv(path: str | Path, header: list[str], rows: list[list]) -> None:
    out = io.StringIO(newline="")
    w = csv.writer(out)
    w.writerow(header)
    w.writerows(rows)
    atomic_write(path, out.getvalue().encode())


def write_table(df: DataFrame, folder: str, kind: str = "csv") -> None:
    """A distributed sink for tables of any size."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(folder) if kind == "csv" else getattr(w, kind)(folder)


def _stat(n: int) -> str:
    return "single" if n == 1 else f"mean+-std over {n} seeds"


def overall_rows(over_seeds: DataFrame) -> list[list]:
    return [[r["method"], _stat(r["n_seeds"]), formats.mean_std(r["mse_mean"], r["mse_std"]), formats.mean_std(r["mae_mean"], r["mae_std"])] for r in over_seeds.orderBy("method").collect()]


def domain_rows(over_seeds: DataFrame) -> list[list]:
    return [[r["method"], r["domain"], "single" if r["n_seeds"] == 1 else "mean+-std", formats.mean_std(r["mse_mean"], r["mse_std"]), formats.mean_std(r["mae_mean"], r["mae_std"])] for r in over_seeds.orderBy("method", "domain").collect()]


def variable_rows(over_seeds: DataFrame, windows: DataFrame) -> list[list]:
    n = windows.groupBy("method", "var_key").agg(F.max("n").alias("n_windows"))
    names = ("mse", "mae", "raw_mse", "raw_mae")
    return [[r["method"], r["var_key"], r["n_windows"], *(formats.mean_std(r[f"{m}_mean"], r[f"{m}_std"]) for m in names)] for r in over_seeds.join(n, ["method", "var_key"]).orderBy("method", "var_key").collect()]


def improvement_rows(counts: DataFrame, level: str) -> list[list]:
    return [[r["method"], f"{level}({r['total']})", r["metric"], r["improved"], r["degraded"], r["equal"], r["total"]] for r in counts.orderBy("method", F.col("metric").desc()).collect()]


def comparison_rows(comparisons: DataFrame) -> list[list]:
    return [[r["comparison"], r["metric"], formats.delta(r["delta"]), formats.relative(r["relative_improvement"])] for r in comparisons.collect()]


def fallback_rows(fallback: DataFrame) -> list[list]:
    return [[r["method"], r["seed"], formats.mean_std(r["overall_mse"], None), formats.mean_std(r["overall_mae"], None), r["n_fallback"]] for r in fallback.orderBy("method", "seed").collect()]


def summary(over_seeds: DataFrame) -> dict:
    """Full-precision [mean, std] of each method; the std of a single run is null."""
    return {"methods_overall": {r["method"]: {m: [r[f"{m}_mean"], r[f"{m}_std"]] for m in ("mse", "mae")} for r in over_seeds.orderBy("method").collect()}}


def markdown(title: str, notes: list[str], overall: list[list], improvements: list[list], comparisons: list[list], fallbacks: list[list], limits: list[str]) -> str:
    def table(header: list[str], rows: list[list]) -> str:
        lines = [header, ["---"] * len(header), *rows]
        return "\n".join("| " + " | ".join(map(str, x)) + " |" for x in lines)

    bullets = lambda xs: "\n".join(f"- {x}" for x in xs)
    parts = [
        f"# {title}",
        bullets(notes),
        "## Overall (standardised)",
        table(["method", "MSE", "MAE"], [[r[0], r[2], r[3]] for r in overall]),
        "## Improved and degraded against the reference method",
        table(["method", "level", "metric", "improved", "degraded", "equal"], [r[:6] for r in improvements]),
        "## Comparisons (overall)",
        table(["comparison", "metric", "delta", "relative"], comparisons),
        "## Fallback to the reference method",
        f"- {sum(r[4] for r in fallbacks)} runs fell back.",
        "## Limits",
        bullets(limits),
    ]
    return "\n\n".join(p for p in parts if p) + "\n"


def write_evidence(checks: DataFrame, folder: str | Path) -> dict:
    """One JSON file a section of ``checks`` (section, item, ok, and any detail) below a path or URI, and the overall verdict."""
    folder = str(folder).rstrip("/")
    rows = [r.asDict() for r in checks.orderBy("section", "item").collect()]
    for s in sorted({r["section"] for r in rows}):
        own = [r for r in rows if r["section"] == s]
        write_json(f"{folder}/{re.sub(r'[^A-Za-z0-9_-]', '_', s)}.json", {"ok": all(bool(r["ok"]) for r in own), "items": own})
    verdict = {"ok": all(bool(r["ok"]) for r in rows), "n": len(rows)}
    write_json(f"{folder}/report.json", verdict)
    return verdict


def ignored(path: str, skip_dirs: tuple[str, ...] = ("__pycache__", "logs", "checkpoints"), keep_arrays_in: tuple[str, ...] = ("predictions",)) -> bool:
    """Whether an audit pack leaves a file out: caches, logs, and arrays outside the folders that keep them."""
    *dirs, name = path.split("/")
    if set(dirs) & set(skip_dirs) or name.endswith(".pyc"):
        return True
    return name.endswith(".npz") and not (dirs and dirs[-1] in keep_arrays_in)


def audit_pack(root: str | Path, out: str | Path) -> list[str]:
    """tar.gz of the files under ``root`` with MANIFEST.sha256 (hash, two spaces, path; by path); returns its lines."""
    root, lines = Path(root), []
    found = [p for p in sorted(root.rglob("*")) if p.is_file() and not ignored(str(p.relative_to(root)))]
    part = f"{out}.{uuid.uuid4().hex}.part"
    with tarfile.open(part, "w:gz") as tar:
        for p in found:
            name = str(p.relative_to(root))
            h = hashlib.sha256()
            with open(p, "rb") as f:
                while piece := f.read(1 << 22):
                    h.update(piece)
            lines.append(f"{h.hexdigest()}  {name}")
            tar.add(p, arcname=name)
        data = ("\n".join(lines) + "\n").encode()
        info = tarfile.TarInfo("MANIFEST.sha256")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    os.replace(part, out)
    return lines
