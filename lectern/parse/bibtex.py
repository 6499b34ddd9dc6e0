"""BibTeX text to rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions.text import decode_latex

def balanced(text: str, at: int, opening: str = "{", closing: str = "}") -> tuple[str, int, bool]:
    """Content of the group that opens at `at`, the place after it, and whether it is closed; escaped marks don't count."""
    depth = 0
    for m in re.compile(r"\\.|[" + re.escape(opening + closing) + "]", re.S).finditer(text, at):
        depth += {opening: 1, closing: -1}.get(m[0], 0)
        if len(m[0]) > 1:
            continue
        if not depth:
            return text[at + 1 : m.start()], m.end(), True
    return text[at + 1 :], len(text), False


_KEY, _NAME = re.compile(r"[^\s,]+"), re.compile(r"[A-Za-z][\w-]*")
_TOKENS = re.compile(r"""(?P<entry>@\w+\s*\{)|(?P<escape>\\.)|(?P<open>\{)|(?P<close>\})|(?P<quote>")|(?P<comma>,)|(?P<equals>=)|(?P<text>[^@\\{}",=]+|.)""", re.S)

#: What a token does in a state. A token that a state doesn't name is `else` there.
_TABLE = {
    "outside": {"else": "skip"},
    "key": {"text": "gather", "escape": "gather", "comma": "take_key", "else": "drop_entry"},
    "name": {"text": "gather", "equals": "take_name", "comma": "forget", "close": "end_entry", "else": "end_entry"},
    "value": {"open": "open_braced", "quote": "open_quoted", "comma": "take_bare", "close": "take_last", "else": "start_bare"},
    "bare": {"comma": "take_bare", "close": "take_last", "else": "gather"},
    "braced": {"open": "deeper", "entry": "deeper", "close": "shallower", "else": "gather"},
    "quoted": {"open": "deeper", "entry": "deeper", "close": "shallower", "quote": "end_quoted", "else": "gather"},
    "after": {"comma": "next_field", "close": "end_entry", "else": "skip"},
}


class _Reader:
    """Reads tokens by the table; each action is a method."""

    def __init__(self) -> None:
        self.found: list[tuple[str, str, dict[str, str]]] = []
        self.problems: list[str] = []
        self._clear()

    def _clear(self) -> None:
        self.state, self.held, self.depth, self.key, self.kind, self.name = "outside", "", 0, "", "", ""
        self.fields: dict[str, str] = {}

    def read(self, kind: str, token: str) -> None:
        if kind == "entry" and self.state not in ("braced", "quoted", "bare"):
            self.end_entry(token)
            self.state, self.kind = "key", token[1:-1].strip().lower()
            return
        actions = _TABLE[self.state]
        getattr(self, actions.get(kind, actions["else"]))(token)

    def skip(self, token: str) -> None:
        pass

    def gather(self, token: str) -> None:
        self.held += token

    def forget(self, token: str) -> None:
        self.held = ""

    def drop_entry(self, token: str) -> None:
        self._clear()

    def take_key(self, token: str) -> None:
        key = self.held.strip()
        if not _KEY.fullmatch(key):
            return self._clear()
        self.key, self.state, self.held = key, "name", ""

    def take_name(self, token: str) -> None:
        name = self.held.strip()
        if not _NAME.fullmatch(name):
            return self.end_entry(token)
        self.name, self.state, self.held = name.lower(), "value", ""

    def start_bare(self, token: str) -> None:
        self.held += token
        if token.strip():
            self.state = "bare"

    def open_braced(self, token: str) -> None:
        self.state, self.depth, self.held = "braced", 1, ""

    def open_quoted(self, token: str) -> None:
        self.state, self.depth, self.held = "quoted", 0, ""

    def deeper(self, token: str) -> None:
        self.depth += 1
        self.held += token

    def shallower(self, token: str) -> None:
        self.depth -= 1
        if self.state == "braced" and not self.depth:
            self._store("after")
        else:
            self.held += token

    def end_quoted(self, token: str) -> None:
        if self.depth > 0:
            self.held += token
        else:
            self._store("after")

    def take_bare(self, token: str) -> None:
        self._store("name")

    def take_last(self, token: str) -> None:
        self._store("after")
        self.end_entry(token)

    def next_field(self, token: str) -> None:
        self.state, self.held = "name", ""

    def _store(self, state: str) -> None:
        self.fields[self.name] = decode_latex(re.sub(r"\s*\n\s*", " ", self.held).strip())
        self.state, self.held, self.depth = state, "", 0

    def end_entry(self, token: str) -> None:
        if self.key:
            self.found.append((self.key, self.kind, self.fields))
        self._clear()

    def finish(self) -> None:
        if self.state in ("braced", "quoted"):
            self.problems.append(f"{self.key}: value of {self.name} is not closed")
        if self.state in ("braced", "quoted", "bare", "value"):
            self._store("after")
        self.end_entry("")


def parse(text: str | None) -> tuple[list[tuple[str, str, dict[str, str]]], list[str]]:
    """Entries (key, type, fields) and diagnostics.

    Anything but an entry with a key is passed over. Types and field names are
    in lower case; a field that comes twice has its last value. A quoted value
    may hold quotes in braces or after a backslash. A value that is never closed
    takes the rest of the text and is reported.
    """
    reader = _Reader()
    for m in _TOKENS.finditer(text or ""):
        reader.read(m.lastgroup, m[0])
    reader.finish()
    return reader.found, reader.problems


def entries(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """path, seq, key, etype, fields of the entries in each row's text; unreadable parts are rows with etype `problem`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, t in zip(pdf["path"], pdf["text"], strict=True):
                found, problems = parse(t)
                rows += [(p, k, key, kind, fields) for k, (key, kind, fields) in enumerate(found)]
                rows += [(p, len(found) + k, "", "problem", {"detail": x}) for k, x in enumerate(problems)]
            yield pd.DataFrame(rows, columns=["path", "seq", "key", "etype", "fields"])

    source = files.select(files[path].alias("path"), files[text].alias("text"))
    return source.mapInPandas(run, "path string, seq long, key string, etype string, fields map<string,string>")
