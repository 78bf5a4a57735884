"""Configuration, run folders and provenance: driver-side and small."""

from __future__ import annotations

import json
import logging
import os
import re
import subprocess
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import yaml

_VARIABLE = re.compile(r"\$\{([A-Za-z_]\w*)\}", re.ASCII)


def expand(value: Any, variables: Mapping[str, str] | None = None) -> Any:
    """value with every ${NAME} in its strings replaced, at any depth; an unset name is an error."""
    known = os.environ if variables is None else variables
    if isinstance(value, str):
        if unset := [n for n in _VARIABLE.findall(value) if n not in known]:
            raise ValueError(f"unset variables: {', '.join(unset)}")
        return _VARIABLE.sub(lambda m: known[m[1]], value)
    if isinstance(value, Mapping):
        return {k: expand(v, known) for k, v in value.items()}
    return [expand(v, known) for v in value] if isinstance(value, list | tuple) else value


def load_config(path: str | Path, required: Sequence[str] = ()) -> dict[str, Any]:
    """A YAML mapping with variables expanded and all required dotted keys there."""
    config = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    config = {} if config is None else config
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no mapping")
    config = expand(config)
    if missing := [k for k in required if not _has(config, k.split("."))]:
        raise ValueError(f"the configuration lacks {', '.join(missing)}")
    return config


def _has(config: Any, keys: list[str]) -> bool:
    return not keys or isinstance(config, Mapping) and keys[0] in config and _has(config[keys[0]], keys[1:])


def safe_name(value: str) -> str:
    if value in ("", ".", "..") or "/" in value or "\\" in value:
        raise ValueError(f"not a plain name: {value!r}")
    return value


def git_commit(folder: str | Path | None = None) -> str:
    done = None
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True)
    except OSError:
        pass
    return done.stdout.strip() if done and done.returncode == 0 and done.stdout.strip() else "UNKNOWN"


@dataclass
class Run:
    """A run's folder and manifest. As a context manager it ends as COMPLETED, or as FAILED if an error leaves it."""

    run_id: str
    created_at_utc: str
    git_commit: str
    config_path: str
    data_version: str
    artifact_name: str
    command: str
    status: str = "RUNNING"
    folder: Path = Path()

    @classmethod
    def start(cls, root: str | Path, artifact_name: str, config_path: str | Path, config: Mapping[str, Any], data_version: str, command: str) -> Run:
        now = datetime.now(UTC)
        run_id = f"{now:%Y%m%dT%H%M%S%f}Z-{uuid.uuid4().hex[:8]}"
        run = cls(run_id, now.isoformat(), git_commit(), str(config_path), data_version, artifact_name, command)
        run.folder = Path(root).expanduser().resolve() / safe_name(artifact_name) / run_id
        run.folder.mkdir(parents=True)
        (run.folder / "used_config.yaml").write_text(yaml.safe_dump(dict(config), sort_keys=False), encoding="utf-8")
        run.write()
        return run

    def write(self, status: str | None = None) -> None:
        self.status = status or self.status
        record = {k: v for k, v in asdict(self).items() if k != "folder"}
        (self.folder / "run_manifest.json").write_text(json.dumps(record, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, *_: object) -> None:
        self.write("FAILED" if kind else "COMPLETED")


def write_report(report: Mapping[str, Any], path: str | Path) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(report, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def configure_logging(level: str = "INFO") -> None:
    logging.basicConfig(level=level.upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s")
