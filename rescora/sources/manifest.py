"""Registries of benchmark datasets: TOML files, validated as a whole before any is used."""

from __future__ import annotations

import os
import re
import shlex
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields

_ID = re.compile(r"[0-9A-Za-z][0-9A-Za-z_-]*")
_TEMPLATE = re.compile(r"\$\{([^}]*)(\}?)")
_REQUIRED = ("id", "source", "organism", "experiment_type", "search_engine", "pin_path", "notes")


@dataclass(frozen=True)
class Dataset:
    id: str
    source: str
    organism: str
    experiment_type: str
    search_engine: str
    pin_path: str
    protein_level_evaluation: bool
    notes: str
    pride_accession: str | None = None
    instrument: str | None = None
    file_count: int | None = None
    approximate_input_size: str | None = None
    preparation: str | None = None
    reference_search_input: str | None = None


class ManifestError(ValueError):
    """All that is wrong with a manifest, in `errors`."""

    def __init__(self, errors: list[str]):
        super().__init__("\n".join(["invalid dataset manifest:", *errors]))
        self.errors = errors


def template_error(text: str) -> str | None:
    for name, end in _TEMPLATE.findall(text):
        if not end:
            return "an unterminated ${...}"
        if not re.fullmatch(r"[A-Z0-9_]+", name):
            return f"an invalid name in ${{{name}}}"
    return None


def expand(text: str, env: Mapping[str, str] | None = None) -> str:
    """${NAME} from the environment; an unset name is an error."""
    env = os.environ if env is None else env
    if why := template_error(text):
        raise ValueError(f"{text} has {why}")

    def value(m: re.Match) -> str:
        if m[1] not in env:
            raise ValueError(f"environment variable {m[1]} is not set")
        return env[m[1]]

    return _TEMPLATE.sub(value, text)


def parse(text: str) -> dict[str, Dataset]:
    """Datasets by id; raises ManifestError with every problem."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ManifestError([str(e)]) from e
    known = {f.name: f for f in fields(Dataset)}
    errors = [f"unknown key {k}" for k in data if k not in ("version", "datasets")]
    if data.get("version") != 1:
        errors.append("version must be 1")
    out: dict[str, Dataset] = {}
    rows = data.get("datasets") or []
    if not rows:
        errors.append("no datasets")
    for k, row in enumerate(rows):
        name = f"datasets[{k}] {row.get('id', '')}".strip()
        wrong = [f"{name}: unknown key {c}" for c in row if c not in known]
        wrong += [f"{name}: {c} is missing" for c in known if c not in row and (c in _REQUIRED or c == "protein_level_evaluation")]
        wrong += [f"{name}: {c} must not be empty" for c, v in row.items() if isinstance(v, str) and not v.strip()]
        if isinstance(row.get("id"), str) and not _ID.fullmatch(row["id"]):
            wrong.append(f"{name}: invalid id")
        if row.get("id") in out:
            wrong.append(f"{name}: id used twice")
        if row.get("file_count") is not None and (not isinstance(row["file_count"], int) or row["file_count"] < 1):
            wrong.append(f"{name}: file_count must be positive")
        if row.get("reference_search_input") not in (None, "concatenated", "separate"):
            wrong.append(f"{name}: reference_search_input must be concatenated or separate")
        if why := template_error(str(row.get("pin_path", ""))):
            wrong.append(f"{name}: pin_path has {why}")
        errors += wrong
        if not wrong:
            out[row["id"]] = Dataset(**row)
    if errors:
        raise ManifestError(errors)
    return out


def timing(text: str) -> tuple[float, int]:
    """Wall seconds and kilobytes of a timing file."""
    wall, rss = text.strip().split("\t")
    return float(wall), int(rss)


def command_line(words: list[str], time_file: str | None = None) -> str:
    """A command as a shell would read it; with a file for its wall time and memory, under the timing tool."""
    timed = ["/usr/bin/time", "-f", r"%e\t%M", "-o", time_file] if time_file else []
    return shlex.join([*timed, *words])
