"""Agent logs as tables of the session model."""

from __future__ import annotations

import io
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from tracemill.model import Parsed
from tracemill.sources import claude, claude_web, codebuddy, codex, copilot, dataclaw, gemini, kiro, openclaw, sqlite, store

READERS = {
    "claude": claude.read,
    "codex": codex.read,
    "gemini": gemini.read,
    "cursor": sqlite.read_cursor,
    "copilot": copilot.read,
    "kiro": kiro.read,
    "hermes": sqlite.read_hermes,
    "opencode": sqlite.read_opencode,
    "kilo": sqlite.read_kilo,
    "openclaw": openclaw.read,
    "codebuddy": codebuddy.read,
    "claude_web": claude_web.read,
    "dataclaw": dataclaw.read,
    "trajectory": store.read_trajectories,
}


def read(spark: SparkSession, agent: str, path: str) -> Parsed:
    if agent not in READERS:
        raise ValueError(f"unknown agent {agent}; known: {', '.join(READERS)}")
    return READERS[agent](spark, path)


def read_all(spark: SparkSession, paths: dict[str, str]) -> Parsed:
    """Several sources as one; where an id occurs in two the one named first wins."""
    out = None
    for agent, path in paths.items():
        p = read(spark, agent, path)
        out = p if out is None else out.union(p)
    return out


def sniff(spark: SparkSession, path: str, order: list[str] | None = None) -> tuple[str, Parsed] | None:
    """The first reader that finds a step in a folder of unknown origin."""
    for agent in order or list(READERS):
        p = READERS[agent](spark, path)
        if not p.steps.limit(1).isEmpty():
            return agent, p
    return None


def unzip(data: bytes, most_files: int = 10_000, most_bytes: int = 2 << 30, endings: tuple[str, ...] = (".jsonl", ".json", ".db")) -> dict[str, bytes]:
    """Files of an uploaded archive by name. Archives that are too large, or reach outside their folder, are refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > most_files or sum(i.file_size for i in infos) > most_bytes:
            raise ValueError("archive is too large")
        for i in infos:
            p = PurePosixPath(i.filename)
            if p.is_absolute() or ".." in p.parts or (i.external_attr >> 16) & 0o170000 == 0o120000:
                raise ValueError(f"archive reaches outside its folder: {i.filename}")
        return {i.filename: z.read(i) for i in infos if i.filename.endswith(endings)}
