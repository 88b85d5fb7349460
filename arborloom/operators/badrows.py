"""Rows that fail to parse: delimited records split into valid typed rows and rejected ones with a reason.

Lines are assembled to records quote-aware, every record goes through Python's strict ``csv`` reader inside one pass over each partition
(``mapInArrow``), and structural exceptions are caught before the typed field constructors run. A row of a table is one record, line breaks
within it included; in files (``sources/formats.py``) a quoted field may go on over lines, and a quote that is never closed costs only its own
line. No shuffle; one narrow pass over the input.
"""

from __future__ import annotations

import csv
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborloom.session import ship_code

FIELDS = ("tok_id", "form", "lemma", "tag", "feature", "relation", "head")
QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"

_TOK_ID = re.compile(r"[1-9][0-9]{0,2}")
_HEAD = re.compile(r"0|[1-9][0-9]{0,2}")
_FORBIDDEN = re.compile("[\x00-\x08\x0a-\x1f\x7f�]")
_BLANK = re.compile(" *")
#: Noncharacters; two that a record does not have stand for its line breaks while the csv reader sees it.
_MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


class Rejected(ValueError):
    """A record that does not parse; the message is the reason."""


class Reader:
    """The strict csv reader, one for many records: ``split`` gives the fields of one record or raises ``Rejected(quoting)``.

    A quoted field must be closed and followed by the delimiter or the end; an unquoted field must not
    contain a double quote (the csv reader takes that one as text, so it is looked for beside it).
    """

    def __init__(self, delimiter: str = "\t"):
        csv.field_size_limit(2**31 - 1)
        self.delimiter, self.line = delimiter, None
        self.rows = csv.reader(self, delimiter=delimiter, quotechar='"', doublequote=True, strict=True)

    def __iter__(self):
        return self

    def __next__(self) -> str:
        line, self.line = self.line, None
        if line is None:
            raise StopIteration
        return line

    def split(self, raw: str) -> list[str]:
        breaks = "\n" in raw or "\r" in raw
        if breaks:
            cr, lf = [c for c in _MARKS if c not in raw][:2]
            raw = raw.replace("\r", cr).replace("\n", lf)
        self.line = raw
        try:
            fields = next(self.rows)
        except csv.Error as e:
            raise Rejected(QUOTING) from e
        if not fields:
            return [""]
        if '"' in raw:
            # Which fields were quoted is not told by the reader: walk over the record, which is well-formed now.
            at = 0
            for field in fields:
                if raw[at : at + 1] == '"':
                    at += len(field) + field.count('"') + 2 + len(self.delimiter)
                elif '"' in field:
                    raise Rejected(QUOTING)
                else:
                    at += len(field) + len(self.delimiter)
        return [x.replace(cr, "\r").replace(lf, "\n") for x in fields] if breaks else fields


def split_record(raw: str, delimiter: str = "\t") -> list[str]:
    """The fields of one record; raises ``Rejected(quoting)``."""
    return Reader(delimiter).split(raw)


def token_row(fields: list[str], tags: frozenset[str]) -> tuple[int, str, str, str, str, str, int]:
    """Typed constructor of a token; raises ``Rejected(value)``."""
    tok_id, form, lemma, tag, feature, relation, head = fields
    if (
        not _TOK_ID.fullmatch(tok_id)
        or not _HEAD.fullmatch(head)
        or tok_id == head
        or tag not in tags
        or not form
        or not lemma
        or any(_FORBIDDEN.search(x) for x in fields)
    ):
        raise Rejected(VALUE)
    return int(tok_id), form, lemma, tag, feature, relation, int(head)


def parse_line(raw: str | None, tags: frozenset[str], reader: Reader | None = None) -> tuple[str, str | None, tuple | None]:
    """``(kind, reason, token)`` of a record; kind is blank, comment, bad or token."""
    if raw is None:
        return "bad", COLUMNS, None
    if raw.endswith("\r"):
        raw = raw[:-1]
    if _BLANK.fullmatch(raw):
        return "blank", None, None
    if raw.startswith("#"):
        return "comment", None, None
    try:
        fields = (reader or Reader()).split(raw)
        if len(fields) != len(FIELDS):
            raise Rejected(COLUMNS)
        return "token", None, token_row(fields, tags)
    except Rejected as e:
        return "bad", str(e), None


def assemble_records(lines: Iterable[str], whole: Callable[[str], bool] = lambda record: True) -> Iterator[str]:
    """Join the lines of a quoted field that goes on over lines: a record ends where its double quotes are even in number.

    Lines joined so that are not a ``whole`` record, or that run to the end, are taken apart again: the first stands alone, as
    a quote that is not closed, and assembly starts anew with the next one. A line is joined at most twice, so the time is linear.
    """
    waiting: deque[str] = deque()
    more = iter(lines)
    end = object()
    while True:
        line = waiting.popleft() if waiting else next(more, end)
        if line is end:
            return
        if line.count('"') % 2 == 0:
            yield line
            continue
        held, at, closed = [line], 0, False
        while not closed:
            if at < len(waiting):
                nxt = waiting[at]
            elif (nxt := next(more, end)) is not end:
                waiting.append(nxt)
            else:
                break
            held.append(nxt)
            at += 1
            closed = nxt.count('"') % 2 == 1
        if closed and whole(record := "\n".join(held)):
            for _ in range(at):
                waiting.popleft()
            yield record
        else:
            yield line


PARSED = T.StructType(
    [
        T.StructField("line_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("tok_id", T.IntegerType()),
        *(T.StructField(x, T.StringType()) for x in FIELDS[1:6]),
        T.StructField("head", T.IntegerType()),
    ]
)


_ARROW = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), *[pa.string()] * 5, pa.int32()]


def parse_lines(lines: DataFrame, tagset: DataFrame) -> DataFrame:
    """Every line of ``lines(line_id, file, line_no, raw)`` with its kind, its reason if bad, its token if valid.

    Defined results: a null line is bad (``columns``); an empty line or one of spaces only is ``blank``
    (tabs separate fields, so a line of six tabs is a record of seven empty fields: ``value``); a line that begins with ``#``
    is a ``comment``; rows repeated in the input are repeated in the output; nulls in line_id, file or
    line_no pass through; an empty table gives an empty table; further columns are ignored; texts of any
    length are parsed whole. The tag set holds one row per part of speech and is read to the driver
    (at most 100,000 tags, checked).
    """
    ship_code(lines.sparkSession)
    found = [r[0] for r in tagset.select("tag").distinct().limit(100_001).collect()]
    if len(found) > 100_000:
        raise ValueError("a tag set of more than 100,000 tags")
    tags = frozenset(x for x in found if x is not None)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, nothing = Reader(), (None,) * len(FIELDS)
        for batch in batches:
            done = [parse_line(x, tags, reader) for x in batch.column("raw").to_pylist()]
            fields = zip(*(token or nothing for _, _, token in done), strict=True) if done else [()] * len(FIELDS)
            columns = [batch.column(x) for x in ("line_id", "file", "line_no")]
            columns += [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())]
            columns += [pa.array(x, t) for x, t in zip(fields, _ARROW[5:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=PARSED.names)

    rows = lines.select(
        F.col("line_id").cast("bigint"), F.col("file").cast("string"), F.col("line_no").cast("int"), F.col("raw").cast("string")
    )
    return rows.mapInArrow(parse, PARSED)


def rejected(parsed: DataFrame) -> DataFrame:
    """The lines that do not parse, with the reason."""
    return parsed.where(F.col("kind") == "bad").select("line_id", "reason")


def tokens(parsed: DataFrame) -> DataFrame:
    """The valid token lines, typed."""
    return parsed.where(F.col("kind") == "token").select("line_id", "file", "line_no", *FIELDS)
