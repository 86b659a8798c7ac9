"""The policy file and the owners file: small, read and checked on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.paths import glob_regex, owners_regex
from ripplegraph.operators.assessment import GATES

CYCLES, MODES = ("off", "warn", "forbid"), ("conservative", "balanced", "fast_feedback")
MOST_LAYERS, MOST_POLICY_BYTES, MOST_OWNERS_BYTES = 64, 1 << 20, 3 << 20
#: Where an owners file may be, the first that is there counts: fixed values.
OWNERS_PATHS = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")


@dataclass
class Policy:
    layers: list[tuple[str, list[str]]] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    cycles: str = "warn"
    critical: list[str] = field(default_factory=list)
    generated: list[str] = field(default_factory=list)
    mode: str = "balanced"
    levels: dict[str, str] = field(default_factory=dict)


def _only(what: dict, keys: str, where: str) -> dict:
    if not isinstance(what, dict):
        raise ValueError(f"{where} must be a mapping")
    if more := set(what) - set(keys.split()):
        raise ValueError(f"unknown keys in {where}: {sorted(more)}")
    return what


def _names(what: object, where: str) -> list[str]:
    if not isinstance(what, list) or not all(isinstance(x, str) and x for x in what):
        raise ValueError(f"{where} must be a list of names")
    return what


def parse_policy(text: str) -> Policy:
    """The policy, or a ValueError that names the first thing wrong: unknown keys, unknown layers, gates, modes, or a gate in both lists."""
    d = _only(yaml.safe_load(text) or {}, "version architecture critical generated tests policy", "the policy")
    if d.get("version") != 1:
        raise ValueError("version must be 1")
    p, a = Policy(), _only(d.get("architecture") or {}, "layers rules cycles", "architecture")
    for layer in a.get("layers") or []:
        _only(layer, "name match", "a layer")
        p.layers.append((layer["name"], [glob_regex(g) for g in _names(layer.get("match"), "match")]))
    names = [n for n, _ in p.layers]
    if len(set(names)) < len(names) or len(names) > MOST_LAYERS:
        raise ValueError("layers must have different names and be no more than 64")
    for i, rule in enumerate(a.get("rules") or []):
        _only(rule, "from deny allow", "a rule")
        if ("deny" in rule) == ("allow" in rule):
            raise ValueError("a rule has either deny or allow")
        targets = _names(rule.get("deny", rule.get("allow")), "a rule's layers")
        if unknown := {rule.get("from"), *targets} - set(names):
            raise ValueError(f"unknown layers: {sorted(map(str, unknown))}")
        p.rules.append({"rule": i, "a": rule["from"], "deny": rule.get("deny"), "allow": rule.get("allow") and [*rule["allow"], rule["from"]]})
    p.cycles = a.get("cycles", "warn")
    if p.cycles not in CYCLES:
        raise ValueError("cycles must be off, warn or forbid")
    p.critical, p.generated = ([glob_regex(g) for g in _names(d.get(k) or [], k)] for k in ("critical", "generated"))
    p.mode = _only(d.get("tests") or {}, "mode", "tests").get("mode", "balanced")
    if p.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    gates = _only(d.get("policy") or {}, "fail_on warn_on", "policy")
    fail, warn = (_names(gates.get(k) or [], k) for k in ("fail_on", "warn_on"))
    if unknown := {*fail, *warn} - set(GATES) | {"config_invalid"} & {*fail, *warn}:
        raise ValueError(f"unknown gates: {sorted(unknown)}")
    if both := set(fail) & set(warn):
        raise ValueError(f"gates in both lists: {sorted(both)}")
    given = "policy" in d
    for g in GATES[:-1]:
        p.levels[g] = "FAIL" if g in fail else "WARN" if g in warn or (not given and g != "architecture_violation") else "OFF"
    p.levels["config_invalid"] = "FAIL"
    if p.cycles == "forbid":
        p.levels["new_cycle"] = "FAIL"
    return p


def parse_owners(text: str) -> tuple[list[tuple[int, str, list[str]]], list[tuple[int, str]]]:
    """Rules (line, regular expression, owners) and errors (line, message). A line is a pattern and its owners; # begins a comment."""
    rules, errors = [], []
    for n, line in enumerate(text.splitlines(), 1):
        parts = line.split("#", 1)[0].replace("\\ ", "\0").split()
        if not parts:
            continue
        pattern, owners = parts[0].replace("\0", " "), parts[1:]
        bad = [o for o in owners if not (o.startswith("@") and len(o) > 1) and not ("@" in o[1:-1])]
        if pattern.startswith("!") or "[" in pattern:
            errors.append((n, f"this pattern is not supported: {pattern}"))
        elif bad:
            errors.append((n, f"this is no owner: {bad[0]}"))
        else:
            rules.append((n, owners_regex(pattern), owners))
    return rules, errors


def _text(spark: SparkSession, root: str, path: str, most: int) -> tuple[str | None, str | None]:
    """A small file's text, or what is wrong with it; both None where there is no such file. Its content is read only if it is small enough."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None, None
    text = F.when(F.col("length") <= most, F.try_validate_utf8(F.col("content").cast("string")))
    top = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}").select("length", text.alias("text")).collect()
    if top[0]["length"] > most:
        return None, f"{path} has more than {most} bytes"
    return (top[0]["text"], None) if top[0]["text"] is not None else (None, f"{path} is no text")


def read_policy(spark: SparkSession, root: str, path: str) -> tuple[Policy, list[str]]:
    """The policy file of a snapshot folder and what is wrong with it; the default policy where there is none, or a wrong one."""
    text, problem = _text(spark, root, path, MOST_POLICY_BYTES)
    if text is None:
        return parse_policy("version: 1"), [problem] if problem else []
    try:
        return parse_policy(text), []
    except (ValueError, yaml.YAMLError) as e:
        return parse_policy("version: 1"), [str(e)]


def read_owners(spark: SparkSession, root: str) -> tuple[list[tuple[int, str, list[str]]], list[tuple[int, str]]]:
    """The rules and errors of the first owners file that a snapshot folder has; none without one."""
    for path in OWNERS_PATHS:
        text, problem = _text(spark, root, path, MOST_OWNERS_BYTES)
        if problem:
            return [], [(0, problem)]
        if text is not None:
            return parse_owners(text)
    return [], []
