"""Log lines on stderr, as text or as one JSON object a line; fields given by extra= are kept."""

from __future__ import annotations

import datetime
import json
import logging
import sys

_OWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.datetime.fromtimestamp(record.created, datetime.UTC).isoformat(timespec="milliseconds")
        line = {"at": at, "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in vars(record).items() if k not in _OWN}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str, ensure_ascii=False)


def set_up(level: str = "INFO", as_json: bool = True) -> None:
    """Of this package's loggers alone; calling it again replaces what it set up before."""
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    own = logging.getLogger("evidence")
    own.handlers, own.propagate = [handler], False
    own.setLevel(level.upper())
