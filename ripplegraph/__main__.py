"""python -m ripplegraph: analyze two snapshot folders, check one, or index one. Exits with 1 where a gate fails, with 2 for what cannot be read."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ripplegraph.plans import analysis
from ripplegraph.sources.policy import read_owners, read_policy


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="ripplegraph", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, places in (("analyze", ("base", "head")), ("check", ("root",)), ("index", ("root", "store"))):
        c = commands.add_parser(name)
        for x in places:
            c.add_argument(x)
        c.add_argument("--policy", default="policy.yml", help="the policy file's path in the snapshot")
        c.add_argument("--mode", choices=("conservative", "balanced", "fast_feedback"))
        c.add_argument("--out", help="a folder for the lists, as JSON")
    a = p.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("ripplegraph").getOrCreate()
    if a.command == "index":
        print(analysis.stored(spark, a.store, analysis.snapshot(spark, a.root, a.store)))
        return 0
    policy, errors = read_policy(spark, a.root if a.command == "check" else a.base, a.policy)
    if a.command == "check":
        found = analysis.check(analysis.snapshot(spark, a.root), policy)
        found.orderBy("f", "t", "kind").show(100, False)
        return 2 if errors else int(not found.isEmpty())
    (head, more), (rules, _) = read_policy(spark, a.head, a.policy), read_owners(spark, a.head)
    got = analysis.analyze(analysis.snapshot(spark, a.base), analysis.snapshot(spark, a.head), policy, mode=a.mode and a.mode.upper(), owner_rules=rules, policy_changed=head != policy, policy_errors=[*errors, *more])
    for name, rows in analysis.report(got).items():
        if a.out:
            rows.write.mode("overwrite").json(f"{a.out}/{name}")
        else:
            print(name)
            rows.show(50, False)
    got.gates.orderBy("gate").show(20, False)
    return int(got.verdict.first()["result"] == "FAIL")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
