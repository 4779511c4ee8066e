"""Data source "sqldump": MySQL/MariaDB dumps as rows, and back, byte for byte except for the values that change.

Reading gives segments in file order: kind "row" for each tuple of an INSERT statement (with its table, columns, tokens and data), kind "text" for
everything between. Files are read by statement, so values may hold line ends, and a statement may put its tuples on one line or
many. One partition reads one file. Writing concatenates raw (or rendered) segments in order of seq.

Paths are on a file system that driver and executors share.
"""

from __future__ import annotations

import codecs
import glob
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from maskframe.functions.literals import LITERAL, escape_text, same_class, unescape_text

# Charset names of dumps, and the hints that announce one.
CHARSETS = {"utf8mb4": "utf-8", "utf8mb3": "utf-8", "utf8": "utf-8", "latin1": "cp1252", "latin": "cp1252", "iso-8859-1": "cp1252", "maccyr": "mac-cyrillic", "1251": "cp1251", "win1251": "cp1251", "windows-1251": "cp1251", "koi8r": "koi8-r"}
_HINTS = [re.compile(rb"SET\s+NAMES\s+'?\"?([\w-]+)", re.I), re.compile(rb"DEFAULT\s+CHARSET\s*=\s*([\w-]+)", re.I), re.compile(rb"--\s*Charset:\s*([\w-]+)", re.I)]
_HEADER = re.compile(r"INSERT\s+(?:IGNORE\s+)?INTO\s+`?([^`\s(]+)`?\s*(\((?:[^()`]|`[^`]*`)*\))?\s*VALUES\s*", re.I)
_QUOTED = re.compile(r"'(?:[^'\\]++|\\.|'')*+'|\"(?:[^\"\\]++|\\.|\"\")*+\"|`[^`]*+`", re.S)
_PIECE = re.compile(rf"{LITERAL}|[(),;'\"`]", re.S)
_BETWEEN = re.compile(r"(?:\s|/\*.*?\*/)*", re.S)
_TAIL = re.compile(r"\s*(?:ON\s+DUPLICATE|AS|RETURNING)\b", re.I)
_STRING = re.compile(r"(\s*)([Nn]?)(['\"])(.*)\3(\s*)", re.S)
SNIFF_BYTES = 1 << 20
SCHEMA = "seq long, kind string, table string, columns array<string>, row long, raw string, tokens array<string>, data array<string>"


def charset(name: str) -> str | None:
    """Python's name of a charset as dumps call it."""
    name = name.strip().lower().replace("_", "-")
    name = CHARSETS.get(name, name)
    try:
        return codecs.lookup(name).name
    except LookupError:
        return None


def decodes(data: bytes, encoding: str) -> bool:
    """Whether data is text in encoding; a character cut off at the end is no error."""
    try:
        codecs.getincrementaldecoder(encoding)().decode(data, final=False)
    except (UnicodeDecodeError, LookupError):
        return False
    return True


def sniff(data: bytes) -> str:
    """The encoding of a dump's beginning: a hint that fits, else the first that decodes, else latin-1."""
    if data.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    for hint in _HINTS:
        m = hint.search(data)
        name = charset(m[1].decode("ascii", "replace")) if m else None
        if name and decodes(data, name):
            return name
    return next((e for e in ("utf-8", "cp1251", "koi8-r", "cp1252") if decodes(data, e)), "latin-1")


def encoding_of(path: str) -> str:
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        return sniff(f.read(SNIFF_BYTES))


#: What ends a quoted run that began before.
_CLOSES = {q: re.compile(rf"(?:[^{q}\\]++|\\.|{q}{q})*+{q}", re.S) for q in "'\""} | {"`": re.compile("[^`]*+`")}
_OPENS = re.compile("['\"`]")


def _open_quote(line: str, quote: str) -> str:
    """The quote that is open after a line, if one was (quote) before it."""
    at = 0
    while True:
        if quote:
            m = _CLOSES[quote].match(line, at)
            if m is None:
                return quote
            at, quote = m.end(), ""
        m = _OPENS.search(line, at)
        if m is None:
            return ""
        at, quote = m.end(), m[0]


def _statements(lines: Iterator[str]) -> Iterator[tuple[bool, str]]:
    """(is an INSERT, text) in order; an INSERT ends with the line that holds its closing semicolon. Each line is looked at once."""
    held: list[str] = []
    quote = ""
    for line in lines:
        if held or _HEADER.match(line) or re.match(r"INSERT\s+INTO\b", line, re.I):
            held.append(line)
            quote = _open_quote(line, quote)
            if not quote and line.rstrip().endswith(";"):
                yield True, "".join(held)
                held = []
        else:
            yield False, line
    if held:
        yield True, "".join(held)


def value_of(token: str) -> str | None:
    """The value of a token; NULL and DEFAULT have none."""
    bare = token.strip()
    if bare.upper() in ("NULL", "DEFAULT"):
        return None
    m = _STRING.fullmatch(token)
    return unescape_text(m[4], m[3]) if m else bare


def rendered(token: str, value: str | None) -> str:
    """token with another value: blanks, prefix and quotes stay; a bare token changes only within its literal class."""
    old = value_of(token)
    if value is None or old is None or value == old:
        return token
    m = _STRING.fullmatch(token)
    if m:
        return f"{m[1]}{m[2]}{m[3]}{escape_text(value, m[3])}{m[3]}{m[5]}"
    return token.replace(old, value) if same_class(old, value) else token


def _tuples(text: str, at: int) -> Iterator[tuple[int, int, list[str]]]:
    """(begin, end, tokens) of each tuple from at on to the end of the statement, parentheses matched at any depth outside quotes."""
    depth, begin, begun, edge, comma, tokens = 0, 0, 0, at, True, []
    for m in _PIECE.finditer(text, at):
        c, i = m[0], m.start()
        if not depth:
            if _TAIL.match(text, edge) and not comma:
                return
            if not _BETWEEN.fullmatch(text, edge, i) or c not in ("(", ",", ";") or (c == "(") != comma:
                raise ValueError(f"can't parse {text[edge : i + 40]!r}")
            if c == ";":
                return
            edge, comma = m.end(), c == ","
        if c == "(":
            if not depth:
                begin, begun, tokens = i, i + 1, []
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                if tokens or i > begun:
                    tokens.append(text[begun:i])
                yield begin, i + 1, tokens
                edge = i + 1
        elif c == "," and depth == 1:
            tokens.append(text[begun:i])
            begun = i + 1
        elif c in "'\"`":
            raise ValueError(f"a quote isn't closed: {text[i : i + 40]!r}")
    if depth or comma or not (_BETWEEN.fullmatch(text, edge) or _TAIL.match(text, edge)):
        raise ValueError(f"a statement isn't closed: {text[begin if depth else edge :][:40]!r}")


def segments(lines: Iterator[str]) -> Iterator[tuple]:
    """The rows and what lies between them. Raises ValueError where the values of an INSERT can't be parsed."""
    seq, rows = 0, {}
    for is_insert, text in _statements(lines):
        head = _HEADER.match(text) if is_insert else None
        if head is None:
            yield seq, "text", None, None, None, text, None, None
            seq += 1
            continue
        at = 0
        while head:
            columns = [c.strip().strip("`") for c in head[2][1:-1].split(",")] if head[2] else []
            table, stop = head[1], head.end()
            for begin, end, tokens in _tuples(text, head.end()):
                yield seq, "text", table, None, None, text[at:begin], None, None
                rows[table] = rows.get(table, 0) + 1
                yield seq + 1, "row", table, columns, rows[table], text[begin:end], tokens, [value_of(x) for x in tokens]
                seq, at, stop = seq + 2, end, end
            # Another INSERT may follow in the same line.
            ends = next((m.end() for m in _PIECE.finditer(text, stop) if m[0] == ";"), len(text))
            head = _HEADER.match(text, _BETWEEN.match(text, ends).end())
        yield seq, "text", table, None, None, text[at:], None, None
        seq += 1


@dataclass
class _File(InputPartition):
    path: str
    number: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.encoding = options.get("encoding")

    def partitions(self):
        paths = sorted(glob.glob(f"{self.path}/*.sql")) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not paths:
            raise FileNotFoundError(self.path)
        return [_File(p, i) for i, p in enumerate(paths)]

    def read(self, partition):
        encoding = self.encoding or encoding_of(partition.path)
        with open(partition.path, encoding=encoding, newline="") as f:
            for seq, *rest in segments(f):
                yield ((partition.number << 40) + seq, *rest)


@dataclass
class _Written(WriterCommitMessage):
    first: int
    path: str | None
    rows: int


class _Writer(DataSourceWriter):
    """Each task writes its rows, which come ordered by seq, to a part; the commit joins the parts in order and moves the whole into place. Without a row
    that was rendered nothing is left behind."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.encoding = options.get("encoding", "utf-8")
        self.need_rows = options.get("need_rows", "true") == "true"

    def write(self, iterator):
        part, first, last, rows = f"{self.path}.{uuid.uuid4().hex}.part", None, None, 0
        try:
            with open(part, "w", encoding="utf-8" if self.encoding == "utf-8-sig" else self.encoding, newline="") as f:
                for r in iterator:
                    if last is not None and r["seq"] < last:
                        raise ValueError("the rows of a dump must be ordered by seq in each partition")
                    first, last = r["seq"] if first is None else first, r["seq"]
                    rows += r["kind"] == "row"
                    f.write(r["raw"])
        except BaseException:
            os.unlink(part)
            raise
        if first is None:
            os.unlink(part)
        return _Written(first or 0, part if first is not None else None, rows)

    def commit(self, messages):
        parts = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.first)
        if self.need_rows and not sum(m.rows for m in parts):
            self.abort(messages)
            raise ValueError("the dump holds no row that could be masked; nothing was written")
        whole = f"{self.path}.{uuid.uuid4().hex}"
        with open(whole, "wb") as out:
            if self.encoding == "utf-8-sig":
                out.write(codecs.BOM_UTF8)
            for m in parts:
                with open(m.path, "rb") as f:
                    while chunk := f.read(1 << 20):
                        out.write(chunk)
                os.unlink(m.path)
        os.replace(whole, self.path)

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.unlink(m.path)


class SqlDump(DataSource):
    """spark.dataSource.register(SqlDump); spark.read.format("sqldump").load(path)"""

    @classmethod
    def name(cls):
        return "sqldump"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)
