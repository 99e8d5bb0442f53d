"""Settings documents: closed schemas, checked before use, merged by precedence; and job plans whose outputs must not overlap."""

from __future__ import annotations

import math
from pathlib import PurePosixPath

#: Fixed values of the settings format.
TOLERANCES = {"linear_deflection_mm", "angular_deflection_rad"}
NESTED = ("visual", "collision")
MODES = ("separate", "visual")


def check_block(block: dict, where: str) -> None:
    """Raises ValueError for unknown keys, wrong types (a boolean is no number), and values out of range."""
    unknown = set(block) - {*NESTED, "collision_mode", "collision_enabled"} if isinstance(block, dict) else {"(not a mapping)"}
    if unknown:
        raise ValueError(f"{where}: unknown {sorted(unknown)}")
    if block.get("collision_mode", MODES[0]) not in MODES or not isinstance(block.get("collision_enabled", True), bool):
        raise ValueError(f"{where}: bad collision setting")
    for name in NESTED:
        values = block.get(name, {})
        if not isinstance(values, dict) or set(values) - TOLERANCES:
            raise ValueError(f"{where}.{name}: unknown tolerance")
        for key, v in values.items():
            good = isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v > 0 and (key != "angular_deflection_rad" or v <= math.pi)
            if not good:
                raise ValueError(f"{where}.{name}.{key}: {v!r}")


def overlaid(*blocks: dict | None) -> dict:
    """Later blocks win; nested tolerances are merged key by key, all else is replaced."""
    out: dict = {}
    for block in blocks:
        for key, value in (block or {}).items():
            out[key] = {**out.get(key, {}), **value} if key in NESTED else value
    if out.get("collision_mode") == "visual":
        out["collision"] = dict(out.get("visual", {}))
    return out


def resolve(preset: dict, config: dict, line: dict, asset: str, part: str | None = None) -> dict:
    """Settings of a part: preset defaults, preset asset, preset part, config defaults, command line, config asset, config part."""
    for name, block in (("preset", preset.get("defaults", {})), ("defaults", config.get("defaults", {})), ("line", line)):
        check_block(block, name)
    base = {"collision_mode": MODES[0], "collision_enabled": True}
    of = lambda doc, group, key: doc.get(group, {}).get(key)
    return overlaid(base, preset.get("defaults"), of(preset, "assets", asset), of(preset, "parts", part), config.get("defaults"), line, of(config, "assets", asset), of(config, "parts", part))


def plan_jobs(job: dict, known: dict[str, tuple[set[str], set[str]]]) -> list[tuple[str, dict]]:
    """(kind, settings) of each stage. ``known``: kind -> (required, optional keys). Unknown kinds and keys, and outputs that are or lie in
    each other, are errors."""
    if set(job) - {"schema_version", "policy", "stages"} or type(job.get("schema_version")) is not int or job["schema_version"] != 1 or not job.get("stages"):
        raise ValueError("not a job of version 1")
    plan, outputs = [], []
    for stage in job["stages"]:
        kind = stage.get("type")
        if kind not in known:
            raise ValueError(f"unknown stage {kind!r}")
        keys, (required, optional) = set(stage) - {"type"}, known[kind]
        if required - keys or keys - required - optional:
            raise ValueError(f"{kind}: needs {sorted(required)}, may have {sorted(optional)}")
        out = PurePosixPath(stage["out"])
        if any(out == o or out in o.parents or o in out.parents for o in outputs):
            raise ValueError(f"outputs overlap: {out}")
        outputs.append(out)
        plan.append((kind, {k: v for k, v in stage.items() if k != "type"}))
    return plan
