"""python -m spindrift.cli verify|build|validate|index-outgoing: datasets from the command line; one line of JSON each."""

from __future__ import annotations

import argparse
import json

from spindrift.plans import dataset
from spindrift.session import session
from spindrift.sources import manifest


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spindrift")
    parser.add_argument("action", choices=("verify", "build", "validate", "index-outgoing"))
    parser.add_argument("--manifest", help="JSON description of the source files")
    parser.add_argument("--sources", help="folder with the source files")
    parser.add_argument("--out", help="folder of the dataset")
    parser.add_argument("--master", default=None)
    chosen = parser.parse_args(args)
    spark = session("spindrift", chosen.master)
    if chosen.action == "validate":
        states = {r.part: r.ok for r in dataset.validate(spark, chosen.out).collect()}
        print(json.dumps(states))
        return int(not all(states.values()))
    if chosen.action == "index-outgoing":
        print(json.dumps(dataset.index_outgoing(spark, chosen.out).first().asDict()))
        return 0
    with open(chosen.manifest) as file:
        described = manifest.load(file.read())
    if chosen.action == "verify":
        states = {r.role: r.state for r in manifest.verify(spark, described, chosen.sources).collect()}
        print(json.dumps(states))
        return int(set(states.values()) != {"ok"})
    print(json.dumps(dataset.build(spark, described, chosen.sources, chosen.out).first().asDict()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
