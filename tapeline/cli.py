"""Command line: bridge, verify, preflight, profile, freshness, replay, report and status."""

from __future__ import annotations

import argparse
import json
import os
import sys

from tapeline import config as cfg
from tapeline.ledger import Ledger
from tapeline.params import FEE_PROFILES
from tapeline.plans import runs
from tapeline.session import local_session
from tapeline.sources import snapshot as snap


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tapeline")
    parser.add_argument("--config", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("bridge", "status"):
        sub.add_parser(name)
    for name in ("verify", "profile", "freshness", "replay", "preflight"):
        p = sub.add_parser(name)
        p.add_argument("snapshot", nargs="?" if name == "preflight" else None)
        p.add_argument("--force-retry", action="store_true")
        if name == "replay":
            p.add_argument("--days", type=int, default=126)
            p.add_argument("--fee-profile", choices=FEE_PROFILES, default="PROD_FLAT")
        if name == "preflight":
            p.add_argument("--mode", choices=("diagnostic", "scheduled"), default="diagnostic")
    sub.add_parser("report").add_argument("run_id", nargs="?")
    args = parser.parse_args(argv)

    config = cfg.load(args.config)
    root, out = config["storage"]["input_root"], config["storage"]["output_root"]
    snapshots, ledger_root, artifacts = os.path.join(root, "snapshots"), config["storage"]["ledger"], os.path.join(out, "runs")
    spark = local_session()
    if args.command == "verify":
        found = snap.verify(spark, os.path.join(snapshots, args.snapshot))
    elif args.command == "preflight":
        found = runs.preflight(config, snapshots, args.snapshot, args.mode == "scheduled", output=out, ledger=ledger_root)
    else:
        found = None
    if found is not None:
        print(json.dumps({"ok": not found, "problems": found}, indent=1))
        return 78 if found else 0
    if args.command == "bridge":
        os.makedirs(snapshots, exist_ok=True)
        sources = [snap.Source(s["name"], s["path"], tuple((t["name"], t["date_column"]) for t in s["tables"])) for s in config["bridge"]["sources"]]
        print(json.dumps({k: v for k, v in snap.bridge(spark, sources, snapshots, config["bridge"].get("keep_snapshots", 2), buckets=config["bridge"].get("buckets", 0)).items() if k != "datasets"}))
    elif args.command in ("profile", "freshness"):
        print(json.dumps(runs.run_profile(spark, snapshots, args.snapshot, ledger_root, artifacts, args.command == "freshness", retry=args.force_retry), default=str))
    elif args.command == "replay":
        print(json.dumps(runs.run_replay(spark, snapshots, args.snapshot, ledger_root, artifacts, args.days, args.fee_profile, retry=args.force_retry), default=str))
    else:
        with Ledger(spark, ledger_root) as ledger:
            if args.command == "status":
                ledger.status().show(truncate=False)
            else:
                recent = ledger.recent_publications(1)
                run_id = args.run_id or (recent[0]["run_id"] if recent else None)
                if not run_id or not ledger.publication_of(run_id):
                    print("no such run", file=sys.stderr)
                    return 1
                with open(os.path.join(artifacts, run_id, "report.md"), encoding="utf-8") as f:
                    print(f.read())
    return 0


if __name__ == "__main__":
    sys.exit(main())
