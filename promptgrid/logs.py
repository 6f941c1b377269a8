"""Logging: to the console, and to a file that rotates, as text or as JSON lines."""

from __future__ import annotations

import gzip
import json
import logging
import logging.handlers
import os
import shutil
import sys
import time

log = logging.getLogger("promptgrid")

TEXT = "%(asctime)s | %(levelname)-8s | %(module)s:%(funcName)s - %(message)s"
MAX_BYTES = 10_000_000
KEEP_DAYS = 7


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        shown = {"time": self.formatTime(record), "level": record.levelname, "module": record.module, "function": record.funcName, "message": record.getMessage()}
        return json.dumps(shown | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}))


class _Rotating(logging.handlers.RotatingFileHandler):
    """Full files are compressed and kept for ``KEEP_DAYS``."""

    def doRollover(self) -> None:
        super().doRollover()
        place, name = os.path.split(self.baseFilename)
        for old in os.listdir(place):
            path = os.path.join(place, old)
            if old.startswith(f"{name}.") and old.endswith(".gz") and time.time() - os.path.getmtime(path) > KEEP_DAYS * 86_400:
                os.remove(path)


def _compressed(source: str, target: str) -> None:
    with open(source, "rb") as plain, gzip.open(target, "wb") as packed:
        shutil.copyfileobj(plain, packed)
    os.remove(source)


def configure(level: str = "INFO", file: str | None = None, template: str | None = None, as_json: bool = False) -> logging.Logger:
    """Sets up this library's log on the driver: the console and, if given, a file; what was set up before is replaced.
    On executors the log goes where the cluster sends the workers' output."""
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if file:
        rotating = _Rotating(file, maxBytes=MAX_BYTES, backupCount=1000)
        rotating.namer, rotating.rotator = lambda name: f"{name}.gz", _compressed
        handlers.append(rotating)
    for handler in handlers:
        handler.setFormatter(_Json() if as_json and template is None else logging.Formatter(template or TEXT))
        log.addHandler(handler)
    log.setLevel(level)
    log.propagate = False
    return log
