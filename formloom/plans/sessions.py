"""Sessions over form sheets: versions kept, writes one at a time, expiry."""

from __future__ import annotations

import json
import threading
import time
import uuid

from .patches import Report, SessionNotFound, Sheets, apply

LIFETIME = 24 * 3600  # fixed value: seconds a session lives


class Sessions:
    def __init__(self, clock=time.time):
        self._clock, self._lock = clock, threading.Lock()
        self._held: dict[str, tuple[float, list[Sheets]]] = {}

    def start(self, sheets: Sheets) -> str:
        key = uuid.uuid4().hex
        self._held[key] = (self._clock() + LIFETIME, [sheets])
        return key

    def current(self, key: str, version: int | None = None) -> Sheets:
        ends, versions = self._held.get(key, (0.0, []))
        if self._clock() >= ends:
            raise SessionNotFound(key)
        return versions[-1] if version is None else next(v for v in versions if v.version == version)

    def patch(self, key: str, patches: list[dict], expected_version: int | None = None, validate_only: bool = False) -> tuple[int, Report]:
        with self._lock:
            new, report = apply(self.current(key), patches, expected_version, validate_only)
            if not validate_only:
                self._held[key][1].append(new)
            return new.version, report

    def export(self, key: str, folder: str, version: int | None = None) -> None:
        """The sheets as a bundle: CSV for survey and choices (a file a partition; rows bear their numbers), JSON for settings."""
        s = self.current(key, version)
        for name, df in (("survey", s.survey), ("choices", s.choices)):
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        settings = s.survey.sparkSession.createDataFrame([(json.dumps(s.settings, ensure_ascii=False),)], "value string")
        settings.coalesce(1).write.mode("overwrite").text(f"{folder}/settings")

    def end(self, key: str) -> None:
        """Ends a session; ending one that is gone is no error."""
        self._held.pop(key, None)


def capabilities() -> dict[str, list[str]]:
    """What the engine can do, by area."""
    from ..expressions.compiler import FUNCTIONS
    from .explore import KINDS
    from .patches import COUNTS

    return {"functions": FUNCTIONS, "summaries": list(KINDS), "patch_counts": list(COUNTS), "filters": ["eq", "in", "between", "regex", "has", "fulltext", "and", "or", "not"]}
