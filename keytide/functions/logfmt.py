"""Log lines as key=value pairs."""

from __future__ import annotations

import logging


def quoted(value: object) -> str:
    text = str(value)
    if text and not any(c in text for c in ' ="\n'):
        return text
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


class LogfmtFormatter(logging.Formatter):
    """ts, level, logger and msg, then the fields given as extra={"fields": {...}}, then the error if there is one."""

    def format(self, record: logging.LogRecord) -> str:
        pairs = {"ts": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname.lower(), "logger": record.name, "msg": record.getMessage()}
        pairs |= getattr(record, "fields", {})
        if record.exc_info:
            pairs["error"] = self.formatException(record.exc_info)
        return " ".join(f"{k}={quoted(v)}" for k, v in pairs.items())
