"""Names of runs, folders and page ranges."""

from __future__ import annotations

from datetime import datetime

from ..operators.ranges import range_name


def stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d-%H%M%S")


def run_id(document: str, first: int | None = None, last: int | None = None, label: str | None = None) -> str:
    """The document with the range's name, else with its page numbers, if any."""
    if label is None and first is None and last is None:
        return document
    return f"{document}_{label if label is not None else f'p{first}_{last}'}"


def output_dir(document: str, label: str = "full", when: str | None = None) -> str:
    return f"output/manual_{document}_{label}_{when or stamp()}"


def cache_dir(root: str, run: str, backend: str = "pipeline") -> str:
    return f"{root.rstrip('/')}/{run}/layout_cache" + ("" if backend == "pipeline" else f"_{backend}")


def snapshot_dir(root: str, run: str, when: str | None = None) -> str:
    return f"{root.rstrip('/')}/{run}/snapshots_{when or stamp()}"


__all__ = ["cache_dir", "output_dir", "range_name", "run_id", "snapshot_dir", "stamp"]
