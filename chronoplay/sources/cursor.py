"""A streaming source for services that answer "what came after this cursor, at most so many".

A poll asks for each user's items after the cursor and takes at most ``limit``;
the answer has items and, if it wants to move the reader on, a new cursor. The
cursors are the stream's offset, so they live in its checkpoint: one moves only
when the service returns it and its batch is planned, and a query that starts
again goes on from there. A batch that is read again asks for the same items.

A stream polls the users of its ``users`` option, some thousands at most, since
their cursors are one offset; more users are more streams.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

LIMIT = 50
ITEMS = "user_id long, cursor long, item string"

#: ``fetch(user_id, after, limit)`` gives ([(cursor of the item, item as JSON text), …] in order, new cursor or None).
Fetch = Callable[[int, int, int], tuple[list[tuple[int, str]], int | None]]


def landed_files(options: dict) -> Fetch:
    """Answers from files that stand for a service: ``<path>/<user>.json``, an array of items with their ``cursor``, in order."""

    def fetch(user: int, after: int, limit: int) -> tuple[list[tuple[int, str]], int | None]:
        at = Path(options["path"]) / f"{user}.json"
        items = [i for i in json.loads(at.read_text()) if i["cursor"] > after][:limit] if at.exists() else []
        return [(i["cursor"], json.dumps(i)) for i in items], items[-1]["cursor"] if items else None

    return fetch


class CursorReader(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Fetch, users: list[int], limit: int):
        self.fetch, self.users, self.limit = fetch, users, limit

    def initialOffset(self) -> dict:
        return {str(u): 0 for u in self.users}

    def _asked(self, user: int, after: int) -> tuple[list[tuple[int, str]], int | None]:
        items, cursor = self.fetch(user, after, self.limit)
        return [i for i in items if i[0] > after][: self.limit], cursor

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end, rows = dict(start), []
        for user in self.users:
            after = start.get(str(user), 0)
            items, cursor = self._asked(user, after)
            end[str(user)] = after if cursor is None else cursor
            # what lies beyond the cursor comes again, so it isn't given now
            rows += [(user, at, item) for at, item in items if at <= end[str(user)]]
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for user, last in end.items():
            after = start.get(user, 0)
            if last > after:
                yield from ((int(user), at, item) for at, item in self._asked(int(user), after)[0] if at <= last)

    def commit(self, end: dict) -> None:
        pass


class CursorSource(DataSource):
    """``spark.readStream.format("cursor")``: options ``service`` (``module:function``, which makes a ``Fetch`` of all options), ``users`` (ids, comma-separated) and ``limit``."""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return ITEMS

    def simpleStreamReader(self, schema) -> CursorReader:
        module, function = self.options.get("service", f"{__name__}:landed_files").split(":")
        users = [int(u) for u in self.options["users"].split(",")]
        return CursorReader(getattr(importlib.import_module(module), function)(self.options), users, int(self.options.get("limit", LIMIT)))
