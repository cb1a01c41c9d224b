"""Manifests of steps, cached steps, claims, reports (K1-K9)."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from importlib import metadata
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.plans.store import Store, digest, file_hashes  # noqa: F401

GATES = ("PASS", "QUALIFIED", "FAIL", "DESCRIPTIVE")
PACKAGES = ("pyspark", "numpy", "pandas", "pyarrow")


def write_frame(df: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, and with ``csv`` one file with a header beside it."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        df.sparkSession.read.parquet(path).coalesce(1).write.mode("overwrite").csv(f"{path}.csv", header=True)


def write_json(document: Mapping, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, indent=2, sort_keys=True, default=str) + "\n")


def file_hash(path: str | Path, algorithm: str = "sha256", chunk: int = 1 << 20) -> str:
    """A streaming hash of one file of the driver."""
    h = hashlib.new(algorithm)
    with open(path, "rb") as f:
        while part := f.read(chunk):
            h.update(part)
    return h.hexdigest()


def package_versions(names: Sequence[str] = PACKAGES) -> dict[str, str]:
    out = {}
    for n in names:
        try:
            out[n] = metadata.version(n)
        except metadata.PackageNotFoundError:
            out[n] = "not-installed"
    return out


def build_manifest(*, analysis: str, input_files: Sequence[str | Path], config: Mapping, random_seed: int | None, split_identifiers: Sequence, runtime_seconds: float, result_files: Sequence[str | Path], claim_boundaries: Sequence[str], gate: str) -> dict:
    """What a result came from. ValueError for an unknown gate, FileNotFoundError for a file that is not there."""
    if gate not in GATES:
        raise ValueError(f"unknown gate: {gate}")
    for p in (*input_files, *result_files):
        if not Path(p).is_file():
            raise FileNotFoundError(f"manifest file is missing: {p}")
    describe = lambda p: {"sha256": file_hash(p), "bytes": Path(p).stat().st_size}
    return {
        "analysis": analysis, "inputs": {str(p): describe(p) for p in input_files}, "config": dict(config), "packages": package_versions(), "random_seed": random_seed, "split_identifiers": list(split_identifiers),
        "runtime_seconds": runtime_seconds, "results": {str(p): describe(p) for p in result_files}, "claim_boundaries": list(claim_boundaries), "gate": gate,
    }


@dataclass(frozen=True)
class Step:
    """A named function of (spark, context) to frames by name, which the context gets; context has earlier frames and 'config'."""

    name: str
    run: Callable[[SparkSession, dict], Mapping[str, DataFrame]]
    config: Mapping = field(default_factory=dict)
    gate: str = "DESCRIPTIVE"
    claim_boundary: str = ""
    needs: tuple[str, ...] = ()


@lru_cache
def library_hash() -> str:
    """Of the library's sources, but for the text operators, which no step uses: a change in what a step calls is a change of the step."""
    root = Path(__file__).resolve().parents[1]
    files = [f for f in sorted(root.rglob("*.py")) if f.relative_to(root).parts[0] != "llm"]
    return hashlib.sha256("".join(f"{f.relative_to(root)}:{file_hash(f)}" for f in files).encode()).hexdigest()


def cache_key(step: Step, inputs: Mapping[str, str], upstream: Mapping[str, str]) -> str:
    """Of the library, the step's code and configuration, the inputs' fingerprints and the keys of the steps it needs."""
    code = step.run.__code__
    text = json.dumps([library_hash(), step.name, hashlib.sha256(code.co_code + repr(code.co_consts).encode()).hexdigest(), dict(step.config), dict(inputs), {n: upstream[n] for n in step.needs}], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def run_steps(spark: SparkSession, steps: Sequence[Step], folder: str, inputs: Mapping[str, str], context: Mapping | None = None, force: bool = False) -> dict[str, dict]:
    """Runs the steps in order, each result a Parquet table under its key; a step whose key has one is REUSED, if its digest still holds.

    ``folder`` is on any file system that Spark reads. Tables are digested by Spark and committed by rename, the step's
    note last. Returns for each step its status, key, gate, claim boundary, seconds and tables.
    """
    ctx, keys, report = dict(context or {}), {}, {}
    store = Store(spark, folder)
    for step in steps:
        missing = [n for n in step.needs if n not in keys]
        if missing:
            raise ValueError(f"step {step.name} needs {missing} before it")
        key = keys[step.name] = cache_key(step, inputs, keys)
        at, note = f"{step.name}/{key}", f"{step.name}/{key}.json"
        began, status = time.time(), "REUSED"
        known = json.loads(store.read_text(note)) if not force and store.exists(note) else None
        if known and all(store.table_digest(f"{at}/{n}") == h for n, h in known["tables"].items()):
            tables = {n: store.read_table(f"{at}/{n}") for n in known["tables"]}
        else:
            status = "RAN"
            tables = {n: store.write_table(f"{at}/{n}", df) for n, df in step.run(spark, ctx | {"config": step.config}).items()}
            store.write_text(note, json.dumps({"step": step.name, "gate": step.gate, "tables": {n: digest(df) for n, df in tables.items()}}, indent=2, sort_keys=True))
        ctx |= tables
        report[step.name] = {"status": status, "key": key, "gate": step.gate, "claim_boundary": step.claim_boundary, "seconds": round(time.time() - began, 3), "tables": {n: store.at(f"{at}/{n}") for n in tables}}
    return report


def display(value: Column, kind: str = "number", digits: int = 4) -> Column:
    """A value as reports print it: a number with fixed digits, a percentage, or a count."""
    if kind == "percent":
        return F.concat(F.format_string(f"%.{digits}f", value * 100), F.lit("%"))
    return F.format_string("%d", value.cast("long")) if kind == "count" else F.format_string(f"%.{digits}f", value.cast("double"))


def recomputed(claims: Mapping[str, tuple[str, str, str, str]], tables: Mapping[str, DataFrame]) -> DataFrame:
    """(claim_id, value, display) from the artifacts: for each claim its table, an SQL aggregate over it, how it is displayed and a condition on its rows.

    Claims on one table are one aggregate of it. ValueError for a claim on a table that isn't there.
    """
    if missing := sorted({t for t, *_ in claims.values()} - set(tables)):
        raise ValueError(f"claims are made on artifacts that are missing: {missing}")
    out = None
    for table in sorted({t for t, *_ in claims.values()}):
        own = {c: x for c, x in claims.items() if x[0] == table}
        filtered = [F.expr(f"{value} FILTER (WHERE {where or 'true'})").cast("double").alias(c) for c, (_, value, _, where) in own.items()]
        rows = F.array(*[F.struct(F.lit(c).alias("claim_id"), F.col(f"`{c}`").alias("value"), display(F.col(f"`{c}`"), kind).alias("display")) for c, (_, _, kind, _) in own.items()])
        one = tables[table].agg(*filtered).select(F.explode(rows).alias("r")).select("r.*")
        out = one if out is None else out.unionByName(one)
    return out


def audit_claims(claims: DataFrame, readme: str) -> DataFrame:
    """claims(claim_id, value, display) with ``status``: PASS if the value is finite and the text holds its display."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return claims.withColumn("status", F.when(finite & F.contains(F.lit(readme), F.col("display")), "PASS").otherwise("FAIL"))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a table, numbers with four places; ValueError for more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has more than {most} rows")
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    return "\n".join([f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *[f"| {' | '.join(map(cell, r))} |" for r in rows]])
