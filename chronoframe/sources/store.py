"""Artifacts that are written once, checked by hash when read, and listed in an append-only registry."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import Strict

REGISTRY = "claim_id string, run_id string, parent_run_id string, stage string, status string, halt_reason string, completed_utc string, trial_count int"


@dataclass(frozen=True)
class FileRef(Strict):
    path: str
    sha256: str


@dataclass(frozen=True)
class LLMCallInfo(Strict):
    model: str
    prompt_sha256: str
    temperature: float | None = None
    seed: int | None = None


@dataclass(frozen=True)
class Manifest(Strict):
    stage: str
    claim_id: str
    run_id: str
    started_utc: str
    status: Literal["complete", "halted", "failed"]
    parent_run_id: str | None = None
    completed_utc: str | None = None
    halt_reason: str | None = None
    inputs: list[FileRef] = field(default_factory=list)
    outputs: list[FileRef] = field(default_factory=list)
    code_commit: str = "unknown"
    common_version: str = "unknown"
    catalogue_sha256: str | None = None
    llm: LLMCallInfo | None = None


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def sha256_of(path: Path) -> str:
    """Hash of a file, or of the names and hashes of a table's part files in order."""
    h = hashlib.sha256()
    if path.is_dir():
        for p in sorted(q for q in path.rglob("*") if q.is_file() and not q.name.startswith(("_", "."))):
            h.update(f"{p.relative_to(path)}:{sha256_of(p)}\n".encode())
        return h.hexdigest()
    with path.open("rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


class Stage:
    """One stage of one run: a folder that must be new, and a manifest when it ends."""

    def __init__(self, store: Store, claim_id: str, run_id: str, name: str, parent_run_id: str | None = None):
        self.store, self.claim_id, self.run_id, self.name, self.parent = store, claim_id, run_id, name, parent_run_id
        self.folder = store.root / claim_id / run_id / name
        self.folder.mkdir(parents=True, exist_ok=False)
        self.started = now()
        self.inputs: list[FileRef] = []
        self.llm: LLMCallInfo | None = None  # the last question of the stage; its log has all

    def write_text(self, name: str, text: str) -> Path:
        path = self.folder / name
        with path.open("x", encoding="utf-8") as f:
            f.write(text)
        return path

    def write_table(self, name: str, df: DataFrame) -> Path:
        df.write.mode("errorifexists").parquet(str(self.folder / name))
        return self.folder / name

    def read_input(self, stage: str, name: str) -> Path:
        """A file of an earlier stage of this run, checked and noted as an input."""
        path = self.store.read(self.claim_id, self.run_id, stage, name)
        self.inputs.append(FileRef(str(path.relative_to(self.store.root)), sha256_of(path)))
        return path

    def _end(self, status: str, reason: str | None, trials: int | None, outputs: list[str] | None, **info) -> Manifest:
        names = outputs if outputs is not None else sorted(p.name for p in self.folder.iterdir())
        refs = [FileRef(n, sha256_of(self.folder / n)) for n in names]
        m = Manifest(self.name, self.claim_id, self.run_id, self.started, status, self.parent, now(), reason, self.inputs, refs, **{"llm": self.llm, **info})
        (self.folder / "manifest.json").write_text(json.dumps(m.to_dict(), indent=2), encoding="utf-8")
        self.store.register(m, trials)
        return m

    def complete(self, trials: int | None = None, outputs: list[str] | None = None, **info) -> Manifest:
        return self._end("complete", None, trials, outputs, **info)

    def halt(self, reason: str, trials: int | None = None, **info) -> Manifest:
        return self._end("halted", reason, trials, None, **info)

    def fail(self, reason: str, trials: int | None = None, **info) -> Manifest:
        return self._end("failed", reason, trials, None, **info)


class Store:
    """A folder of claims and their registry. The folder must be one that the driver can open; tables in
    it are written by Spark, so on a cluster it is a mounted shared folder."""

    def __init__(self, root: str | Path, spark: SparkSession | None = None, lock_seconds: float = 10.0):
        self.root, self.spark, self.lock_seconds = Path(root), spark, lock_seconds
        self.root.mkdir(parents=True, exist_ok=True)
        self.path = self.root / "registry.jsonl"

    def begin(self, claim_id: str, run_id: str, stage: str, parent_run_id: str | None = None) -> Stage:
        return Stage(self, claim_id, run_id, stage, parent_run_id)

    def manifest(self, claim_id: str, run_id: str, stage: str) -> Manifest:
        return Manifest.from_dict(json.loads((self.root / claim_id / run_id / stage / "manifest.json").read_text()))

    def read(self, claim_id: str, run_id: str, stage: str, name: str) -> Path:
        """The path of a listed output whose hash is still the manifest's."""
        listed = {o.path: o.sha256 for o in self.manifest(claim_id, run_id, stage).outputs}
        if name not in listed:
            raise KeyError(f"{stage} lists no output {name!r}")
        path = self.root / claim_id / run_id / stage / name
        if (found := sha256_of(path)) != listed[name]:
            raise ValueError(f"{path} has sha256 {found}, its manifest says {listed[name]}")
        return path

    @contextlib.contextmanager
    def _lock(self):
        lock, until = self.root / "registry.lock", time.monotonic() + self.lock_seconds
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                break
            except FileExistsError:
                if time.monotonic() > until:
                    raise TimeoutError(f"{lock} is held") from None
                time.sleep(0.02)
        try:
            yield
        finally:
            lock.unlink()

    def rows(self) -> list[dict]:
        return [json.loads(x) for x in self.path.read_text().splitlines()] if self.path.exists() else []

    def register(self, m: Manifest, trials: int | None = None) -> None:
        """Append a row unless (claim, run, stage) is there; the file is replaced in one step."""
        with self._lock():
            rows = self.rows()
            if any((r["claim_id"], r["run_id"], r["stage"]) == (m.claim_id, m.run_id, m.stage) for r in rows):
                return
            count = trials if trials is not None else max((r["trial_count"] for r in rows if r["claim_id"] == m.claim_id), default=0)
            rows.append({"claim_id": m.claim_id, "run_id": m.run_id, "parent_run_id": m.parent_run_id, "stage": m.stage, "status": m.status, "halt_reason": m.halt_reason, "completed_utc": m.completed_utc, "trial_count": int(count)})
            fresh = self.path.with_suffix(".new")
            fresh.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
            os.replace(fresh, self.path)

    def registry(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.values()) for r in self.rows()], REGISTRY)

    def trial_count(self, claim_id: str) -> int:
        return max((r["trial_count"] for r in self.rows() if r["claim_id"] == claim_id), default=0)

    def run_ids(self, claim_id: str) -> list[str]:
        return sorted({r["run_id"] for r in self.rows() if r["claim_id"] == claim_id})


def append_once(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, those of ``new`` only where their key is not there yet (nor twice in ``new``)."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(existing.columns))


def trial_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("claim_id").agg(F.max("trial_count").alias("trial_count"))
