"""Payload templates compiled once, on the driver, to a Column over a batch row.

The accepted forms are ``{{ value }}``, ``{{ value | date: 'format' }}``, one
level of ``{% for x in tags %} ... {% endfor %}``, and inside it
``{% if [not] forloop.last %}`` or ``{% unless forloop.last %}`` (also with
``forloop.first``).  Anything else raises ``ValueError``.  Names ignore case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import local_time
from .text import iso_utc, number_text

# Template names of batch and tag fields and the columns behind them.
CONFIG_FIELDS = {
    "readerid": "reader_id", "deviceid": "reader_id", "device_id": "reader_id",
    "brandname": "brand_name", "location": "brand_name", "providerid": "provider_id",
}
TAG_FIELDS = {
    "epc": "epc", "tid": "tid", "usermemory": "user_memory", "antennaport": "antenna_port", "rssi": "rssi",
    "readcount": "read_count", "firstseentime": "first_seen", "lastseentime": "last_seen",
    "readerid": "reader_id", "location": "location",
}

# Date directives of the templates and the matching pattern letters.
DATE_DIRECTIVES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "I": "hh", "p": "a",
    "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "L": "SSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
}

_MARK = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_FOR = re.compile(r"for\s+(\w+)\s+in\s+tags$", re.I)
_CONDITION = re.compile(r"(if\s+not|if|unless)\s+forloop\.(last|first)$", re.I)
_INDEXED = re.compile(r"tags\[(\d+)\]\.(\w+)$", re.I)
_DATE = re.compile(r"date\s*:\s*(?:'([^']*)'|\"([^\"]*)\")$", re.I)
_TIMES = {"first_seen", "last_seen", "rendered_at"}


def date_pattern(directives: str) -> str:
    """A ``%Y-%m-%d`` style format as a datetime pattern."""
    out = []
    for match in re.finditer(r"%(.)|([^%]+)", directives):
        directive, literal = match.groups()
        if literal is not None:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m.group()}'", literal.replace("'", "''")))
        elif directive == "%":
            out.append("%")
        elif directive in DATE_DIRECTIVES:
            out.append(DATE_DIRECTIVES[directive])
        else:
            raise ValueError(f"unsupported date directive %{directive}")
    return "".join(out)


def field_text(source: Column, column: str) -> Column:
    """A field as template text: numbers short, times in UTC, a missing value empty."""
    value = source[column]
    if column in _TIMES:
        value = F.date_format(local_time(value, "UTC"), "yyyy-MM-dd HH:mm:ss'Z'")
    elif column in ("rssi", "antenna_port", "read_count"):
        value = number_text(value)
    return F.coalesce(value.cast("string"), F.lit(""))


class _Scope:
    """Names visible at one point of the template."""

    def __init__(self, loop: str | None = None, tag: Column | None = None, at: Column | None = None,
                 size: Column | None = None):
        self.loop, self.tag, self.at, self.size = loop, tag, at, size

    def value(self, expression: str) -> Column:
        name, *filters = [part.strip() for part in expression.split("|")]
        source, column = self._resolve(name)
        if not filters:
            return column if source is None else field_text(source, column)
        date = _DATE.match(filters[0])
        if len(filters) > 1 or date is None:
            raise ValueError(f"unsupported filter in {expression!r}")
        if name.lower() == "current_utc_iso":
            instant = F.col("rendered_at")
        elif source is not None and column in _TIMES:
            instant = source[column]
        else:
            raise ValueError(f"{name!r} is not a time")
        pattern = date_pattern(date.group(1) if date.group(1) is not None else date.group(2))
        return F.coalesce(F.date_format(local_time(instant, "UTC"), pattern), F.lit(""))

    def _resolve(self, name: str):
        lower = name.lower()
        if lower == "tags.size":
            return None, F.size("tags").cast("string")
        if lower == "transaction_id":
            return None, F.col("transaction_id")
        if lower == "current_utc_iso":
            return None, iso_utc(F.col("rendered_at"))
        head, _, rest = lower.partition(".")
        if head == "config" and rest in CONFIG_FIELDS:
            return None, F.coalesce(F.col(CONFIG_FIELDS[rest]), F.lit(""))
        indexed = _INDEXED.match(name)
        if indexed and indexed.group(2).lower() in TAG_FIELDS:
            return F.get("tags", F.lit(int(indexed.group(1)))), TAG_FIELDS[indexed.group(2).lower()]
        if self.tag is not None and head == self.loop and rest in TAG_FIELDS:
            return self.tag, TAG_FIELDS[rest]
        if self.tag is not None and lower in ("forloop.index", "forloop.index0"):
            return None, (self.at + (1 if lower == "forloop.index" else 0)).cast("string")
        raise ValueError(f"unknown template name {name!r}")

    def condition(self, match: re.Match) -> Column:
        if self.tag is None:
            raise ValueError("forloop is only known inside a loop")
        holds = self.at == (self.size - 1 if match.group(2).lower() == "last" else 0)
        return holds if match.group(1).lower() == "if" else ~holds


def _block(parts: list[str], at: int, end: tuple[str, ...], scope: _Scope) -> tuple[Column, int]:
    """Text of the parts from ``at`` up to one of the closing tags."""
    pieces: list[Column] = []
    while at < len(parts):
        part = parts[at]
        if part.startswith("{{"):
            pieces.append(scope.value(part[2:-2].strip()))
        elif part.startswith("{%"):
            tag = part[2:-2].strip()
            if tag.lower() in end:
                return _joined(pieces), at
            loop, test = _FOR.match(tag), _CONDITION.match(tag)
            if loop and scope.tag is None:
                at, column = _loop(parts, at, loop.group(1).lower())
            elif test:
                closing = "endunless" if test.group(1).lower() == "unless" else "endif"
                body, at = _block(parts, at + 1, (closing,), scope)
                column = F.when(scope.condition(test), body).otherwise(F.lit(""))
            else:
                raise ValueError(f"unsupported template tag {tag!r}")
            pieces.append(column)
        elif part:
            pieces.append(F.lit(part))
        at += 1
    if end:
        raise ValueError(f"missing {end[0]}")
    return _joined(pieces), at


def _loop(parts: list[str], at: int, name: str) -> tuple[int, Column]:
    closed = [at]

    def render(tag: Column, index: Column) -> Column:
        body, closed[0] = _block(parts, at + 1, ("endfor",), _Scope(name, tag, index, F.size("tags")))
        return body

    text = F.array_join(F.transform("tags", render), "")
    return closed[0], text


def _joined(pieces: list[Column]) -> Column:
    return F.concat(*pieces) if pieces else F.lit("")


def compile_template(source: str) -> Column:
    """Column that renders the template for a row with ``tags``, ``transaction_id`` and the reader columns."""
    # A dash inside a mark swallows the white space next to it.
    source = re.sub(r"-([}%]\})\s*", r"\1", re.sub(r"\s*(\{[{%])-", r"\1", source))
    if "{{" in re.sub(_MARK, "", source) or "{%" in re.sub(_MARK, "", source):
        raise ValueError("unclosed template mark")
    column, _ = _block(_MARK.split(source), 0, (), _Scope())
    return column
