"""Sessions that can be taken up again: answers are saved by signature and given back for free."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import time
from collections.abc import Callable
from contextlib import closing

from .api import Response, Transport


class Session:
    """A file of saved answers and failures, valid for one signature of scope and credentials."""

    def __init__(self, path: str, signature: dict, version: int = 1):
        self.sign = hashlib.sha256(json.dumps([version, signature], sort_keys=True).encode()).hexdigest()
        self.db = sqlite3.connect(path, check_same_thread=False)
        with self.db:
            self.db.execute("create table if not exists session (sign text, began real)")
            self.db.execute("create table if not exists answers (key text primary key, status integer, body text, headers text)")
            self.db.execute("create table if not exists failures (at real, what text)")
        found = self.db.execute("select sign, began from session").fetchone()
        self.resumed = bool(found) and found[0] == self.sign
        if not self.resumed:
            self.discard()
            with self.db:
                self.db.execute("insert into session values (?, ?)", (self.sign, time.time()))
        self.began = self.db.execute("select began from session").fetchone()[0]

    @staticmethod
    def key(method: str, url: str, body: str) -> str:
        return hashlib.sha256("\x00".join((method, url, body)).encode()).hexdigest()

    def load(self, key: str) -> Response | None:
        row = self.db.execute("select status, body, headers from answers where key = ?", (key,)).fetchone()
        return Response(row[0], row[1], json.loads(row[2])) if row else None

    def save(self, key: str, r: Response) -> None:
        with self.db:
            self.db.execute("insert or replace into answers values (?, ?, ?, ?)", (key, r.status, r.body, json.dumps(r.headers)))

    def failed(self, what: str) -> None:
        with self.db:
            self.db.execute("insert into failures values (?, ?)", (time.time(), what))

    def inspect(self) -> dict:
        n = lambda t: self.db.execute(f"select count(*) from {t}").fetchone()[0]
        last = self.db.execute("select what from failures order by at desc limit 1").fetchone()
        return {"began": self.began, "answers": n("answers"), "failures": n("failures"), "last_failure": last[0] if last else None}

    def discard(self) -> None:
        """After a commit, or for another signature."""
        with self.db:
            for t in ("session", "answers", "failures"):
                self.db.execute(f"delete from {t}")

    def close(self) -> None:
        self.db.close()

    def over(self, send: Transport, valid: Callable[[Response], bool] = lambda r: r.status == 200) -> Transport:
        """``send`` with saved answers first; only valid ones are saved."""

        def run(method: str, url: str, headers: dict[str, str], body: str) -> Response:
            key = self.key(method, url, body)
            if (known := self.load(key)) is not None:
                return known
            try:
                r = send(method, url, headers, body)
            except Exception as why:
                self.failed(str(why))
                raise
            if valid(r):
                self.save(key, r)
            return r

        return run


def inspect(path: str) -> dict | None:
    """What a session file holds, without opening it for a run."""
    with closing(sqlite3.connect(path)) as db:
        try:
            return {"answers": db.execute("select count(*) from answers").fetchone()[0], "began": db.execute("select began from session").fetchone()[0]}
        except (sqlite3.Error, TypeError):
            return None
