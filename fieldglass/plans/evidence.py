"""Evidence documents of selections, as JSON and Markdown, in bundles that appear whole or not at all."""

from __future__ import annotations

import itertools
import json
import os
import re
import shutil
import tempfile
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selection import lowest_rows

VERSION = 1
#: Largest document that is read.
DOCUMENT_BYTES = 8 << 20
#: Row ids a document lists at most.
SAMPLE = 10_000
_counter = itertools.count()


@dataclass(frozen=True)
class Evidence:
    """A selection with its context: source, projection, cohort, view, counts and a sample of the lowest row ids."""

    source: str
    mode: str
    projection: dict
    cohort: dict
    view: dict
    total_rows: int
    included_rows: int
    selected_rows: int
    row_ids: tuple[int, ...]
    pinned: dict | None = None
    version: int = VERSION
    notes: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if not 0 <= self.selected_rows <= self.included_rows <= self.total_rows:
            raise ValueError("counts must satisfy selected <= included <= total")
        if len(self.row_ids) > min(SAMPLE, self.selected_rows):
            raise ValueError("the sample holds more rows than are selected or allowed")
        if list(self.row_ids) != sorted(set(self.row_ids)):
            raise ValueError("sampled row ids must be sorted and distinct")
        if self.version != VERSION:
            raise ValueError(f"unknown document version {self.version}")

    @property
    def sampled(self) -> bool:
        return self.selected_rows > len(self.row_ids)

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"sampled": self.sampled}, indent=2, sort_keys=True)

    def to_markdown(self) -> str:
        rows = {"Source": redact_path(self.source), "Mode": self.mode, "Rows": self.total_rows, "Included": self.included_rows, "Selected": self.selected_rows, "Sampled": "yes" if self.sampled else "no"}
        rows |= {f"Projection {k}": v for k, v in self.projection.items()} | {f"Cohort {k}": v for k, v in self.cohort.items()} | {f"View {k}": v for k, v in self.view.items()}
        body = "\n".join(f"| {escape_cell(str(k))} | {escape_cell(str(v))} |" for k, v in rows.items())
        ids = ", ".join(map(str, self.row_ids[:20]))
        return f"# Selection evidence\n\n| Field | Value |\n| --- | --- |\n{body}\n\nRow ids: {ids}\n"


def decode(data: bytes) -> Evidence:
    """A document back from its JSON; larger or newer ones are refused."""
    if len(data) > DOCUMENT_BYTES:
        raise ValueError("the document is larger than 8 MiB")
    raw = json.loads(data)
    raw.pop("sampled", None)
    if raw.get("version") != VERSION:
        raise ValueError(f"unknown document version {raw.get('version')!r}")
    return Evidence(**raw | {"row_ids": tuple(raw["row_ids"]), "notes": tuple(raw.get("notes", ()))})


def escape_cell(text: str) -> str:
    """Text safe in a Markdown table."""
    return re.sub(r"\r?\n|\r", " ", text.replace("\\", "\\\\").replace("|", "\\|")).replace("<", "&lt;").replace(">", "&gt;").replace("`", "\\`")


def redact_path(path: str) -> str:
    """The file name without its folders."""
    return re.split(r"[\\/]", path.rstrip("/\\"))[-1]


def evidence_of(rows: DataFrame, selected: F.Column, row_id: str, source: str, mode: str, projection: dict, cohort: dict, view: dict, included: str = "included", keep: int = SAMPLE) -> Evidence:
    """Count in one aggregate, and take the lowest ids with bounded heaps."""
    inside = F.col(included) & selected
    total, inc, sel = rows.agg(F.count(F.lit(1)), F.count_if(F.col(included)), F.count_if(inside)).first()
    ids = tuple(r[0] for r in lowest_rows(rows.where(inside).select(row_id), row_id, min(keep, SAMPLE)).collect())
    return Evidence(source, mode, projection, cohort, view, total, inc, sel, ids)


def evidence_rows(rows: DataFrame, selected: F.Column, row_id: str, keep: int = 100) -> DataFrame:
    """One row (selected_rows, sample, document): the counts and lowest ids as JSON, made by Spark."""
    counts = rows.agg(F.count_if(selected).alias("selected_rows"), F.count(F.lit(1)).alias("total_rows"))
    ids = lowest_rows(rows.where(selected).select(F.col(row_id).cast("long").alias("r")), "r", keep).agg(F.array_sort(F.collect_list("r")).alias("row_ids"))
    one = counts.join(ids)
    return one.select("selected_rows", "total_rows", F.to_json(F.struct("selected_rows", "total_rows", "row_ids")).alias("document"))


def write_bundle(folder: str, evidence: Evidence, prefix: str = "evidence", context: str = "") -> str:
    """Write evidence.json, evidence.md, manifest.json and visual-context.txt to a new folder; it is renamed into place last."""
    os.makedirs(folder, exist_ok=True)
    name = f"{prefix}-{int(time.time() * 1000)}-{next(_counter)}"
    part = tempfile.mkdtemp(prefix=f".{name}-", dir=folder)
    try:
        files = {"evidence.json": evidence.to_json(), "evidence.md": evidence.to_markdown(), "visual-context.txt": context}
        files["manifest.json"] = json.dumps({"version": VERSION, "files": sorted(files)}, indent=2)
        for n, text in files.items():
            with open(os.path.join(part, n), "w", encoding="utf-8") as out:
                out.write(text)
        target = os.path.join(folder, name)
        os.rename(part, target)
    except BaseException:
        shutil.rmtree(part, ignore_errors=True)
        raise
    return target


def write_intervals(intervals: DataFrame, path: str) -> None:
    """Interval rows as CSV; the committer publishes the folder when all tasks are done."""
    intervals.write.mode("errorifexists").option("header", True).csv(path)


def record_ids_json(ids: F.Column) -> F.Column:
    """An array of ids as JSON text."""
    return F.to_json(ids)
