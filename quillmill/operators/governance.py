"""Rules on small JSON objects (manifests, checkpoint metadata, configurations), and content hashes.

Rules are data: a field, what it must be, and the message. They run on the driver, where such objects live."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Check = Callable[[Any], str | None]


def text(value: Any) -> str | None:
    return None if isinstance(value, str) and value else "must be a non-empty string"


def one_of(*allowed: str) -> Check:
    return lambda v: None if isinstance(v, str) and v in allowed else f"must be one of {sorted(allowed)}"


def texts(pattern: str | None = None) -> Check:
    def check(value: Any) -> str | None:
        if not isinstance(value, list) or not value:
            return "must be a non-empty array"
        if not all(isinstance(x, str) and x for x in value):
            return "must contain only non-empty strings"
        if len(set(value)) < len(value):
            return "must not contain duplicates"
        bad = [x for x in value if pattern and not re.fullmatch(pattern, x)]
        return f"contains invalid tag: {bad[0]}" if bad else None

    return check


def count(allow_bool: bool = False) -> Check:
    return lambda v: None if isinstance(v, int) and (allow_bool or not isinstance(v, bool)) and v >= 0 else "must be a non-negative integer"


def an_object(value: Any) -> str | None:
    return None if isinstance(value, dict) else "must be an object"


def fields(**rules: Check) -> Check:
    """An object whose fields follow ``rules``."""

    def check(value: Any) -> str | None:
        if not isinstance(value, dict):
            return "must be an object"
        bad = [f"{name} {why}" for name, rule in rules.items() if (why := rule(value.get(name)))]
        return "; ".join(bad) or None

    return check


def optional(rule: Check) -> Check:
    return lambda v: None if v is None else rule(v)


def matching(pattern: str, why: str) -> Check:
    return lambda v: None if isinstance(v, str) and re.fullmatch(pattern, v) else why


def flag(value: Any) -> str | None:
    return None if isinstance(value, bool) else "must be a boolean"


# The fields of a dataset manifest and of checkpoint metadata, and the words they may hold.
_STATUS = one_of("not_started", "planned", "complete", "not_applicable")
_CHECKED = fields(required=flag, method=text, status=_STATUS)
MANIFEST: dict[str, Check] = {
    "name": text,
    "version": text,
    "source": text,
    "license": text,
    "license_review": one_of("compatible", "needs_review", "restricted", "rejected"),
    "use": one_of("pretraining", "supervised_fine_tuning", "preference_training", "evaluation", "tokenizer"),
    "languages": texts(r"[a-z]{2,3}(-[A-Z]{2})?"),
    "domains": texts(),
    "estimated_tokens": count(allow_bool=True),
    "retrieval_script": text,
    "processing_config": text,
    "filters": texts(),
    "status": one_of("candidate", "approved", "quarantined", "rejected", "deprecated"),
    "pii_policy": _CHECKED,
    "contamination_check": _CHECKED,
}
MANIFEST_OPTIONAL: dict[str, Check] = {"reviewed_at": optional(matching(r"\d{4}-\d{2}-\d{2}", "must use YYYY-MM-DD"))}
CHECKPOINT: dict[str, Check] = {
    "model_name": text,
    "model_size": text,
    "architecture": an_object,
    "tokenizer_version": text,
    "training_token_count": count(),
    "dataset_manifest_hash": text,
    "training_config_hash": text,
    "commit_sha": text,
    "license": text,
    "intended_status": one_of("experiment", "candidate", "release"),
}


def violations(value: Any, rules: dict[str, Check], extra: dict[str, Check] | None = None, closed: bool = False) -> list[str]:
    """What breaks the rules: missing fields, fields of the wrong kind, and, where ``closed``, unknown fields."""
    if not isinstance(value, dict):
        return ["root must be an object"]
    known = rules | (extra or {})
    missing = sorted(rules.keys() - value.keys())
    out = [f"missing required fields: {', '.join(missing)}"] if missing else []
    if closed and (unknown := sorted(value.keys() - known.keys())):
        out.append(f"unexpected fields: {', '.join(unknown)}")
    return out + [f"{name} {why}" for name, rule in known.items() if name in value and (why := rule(value[name]))]


def manifest_violations(manifest: Any) -> list[str]:
    """Unknown keys are allowed in a manifest."""
    return violations(manifest, MANIFEST, MANIFEST_OPTIONAL)


def checkpoint_violations(meta: Any) -> list[str]:
    """Unknown keys aren't allowed in checkpoint metadata."""
    return violations(meta, CHECKPOINT, closed=True)


def checkpoint_metadata(**values: Any) -> dict[str, Any]:
    """Validated metadata in the order of the rules; ``ValueError`` says what is wrong."""
    if bad := checkpoint_violations(values):
        raise ValueError("invalid checkpoint metadata: " + "; ".join(bad))
    return {name: values[name] for name in CHECKPOINT}


def config_violations(config: Any) -> list[str]:
    """Rules of an evaluation configuration with nested tasks."""
    out = violations(config, {"eval_id": text, "version": lambda v: None, "model": fields(id=lambda v: None if isinstance(v, str) else "must be present"), "tasks": lambda v: None if isinstance(v, list) and v else "must be a non-empty array"})
    seen: set[str] = set()
    for k, task in enumerate(config.get("tasks") or [] if isinstance(config, dict) else []):
        why = fields(id=text, area=text, type=text, prompt=text, expected_behavior=text)(task)
        out += [f"tasks[{k}]: {why}"] if why else []
        name = task.get("id") if isinstance(task, dict) else None
        out += [f"duplicate task id: {name}"] if name in seen else []
        seen.add(name)
    return out


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks: equal values have equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()


def file_hash(path: str | Path) -> str:
    with Path(path).open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_hashes(raw: DataFrame) -> DataFrame:
    """(path, sha256) of whole files read as bytes."""
    return raw.select("path", F.sha2("raw", 256).alias("sha256"))


def current_commit(root: str | Path = ".") -> str:
    """The commit of a working tree, or "unknown"."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def save_json(path: str | Path, value: Any) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def corpus_manifest(paragraphs: DataFrame, name: str, version: str) -> dict[str, Any]:
    """Provenance of a gathered corpus: totals by language and source, and a hash of its ids and texts.

    The hash is of the sorted row hashes' sum, so it doesn't depend on how the rows are spread."""
    per = paragraphs.groupBy("language", "key").agg(F.count("*").alias("paragraphs_used"), F.sum("bytes").alias("bytes_used")).orderBy("language", "key").collect()
    total = paragraphs.agg(F.coalesce(F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\0", "id", "text"), 256), 1, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()[0]
    return {"name": name, "version": version, "totals": {"records": sum(r["paragraphs_used"] for r in per), "bytes": sum(r["bytes_used"] for r in per)}, "sources": [r.asDict() for r in per], "content_sum": total}
