"""``python -m lotwise.plans.cli STEP... --data SF_DIR --output DIR``: runs steps of the analysis, or all."""

from __future__ import annotations

import argparse
import json

from lotwise.plans import manifest, pipeline
from lotwise.plans.store import Store, digest
from lotwise.session import session
from lotwise.sources import tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Runs steps of the analysis.")
    p.add_argument("steps", nargs="*", help="names of steps, with those they need; none for all")
    p.add_argument("--data", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--force", action="store_true")
    p.add_argument("--list", action="store_true")
    a = p.parse_args(argv)
    if a.list:
        print("\n".join(s.name for s in pipeline.STEPS))
        return 0
    wanted, known = set(a.steps or [s.name for s in pipeline.STEPS]), {s.name: s for s in pipeline.STEPS}
    if unknown := sorted(wanted - set(known)):
        p.error(f"unknown steps: {unknown}")
    while more := {n for s in wanted for n in known[s].needs} - wanted:
        wanted |= more
    spark = session()
    inputs = {t: digest(spark.read.parquet(f"{a.data}/{t}.parquet")) for t in ("events", "lineitem", "embeddings")}
    ctx = {"traces": tables.traces(spark, a.data), "dense": tables.dense(spark, a.data), "sparse": tables.sparse(spark, a.data), "spectra": tables.spectra(spark, a.data)}
    report = manifest.run_steps(spark, [s for s in pipeline.STEPS if s.name in wanted], a.output, inputs, ctx, a.force)
    Store(spark, a.output).write_text("summary.json", json.dumps(report, indent=2, sort_keys=True))
    print(json.dumps({k: v["status"] for k, v in report.items()}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
