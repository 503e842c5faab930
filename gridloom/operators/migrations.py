"""Stored records of many schema versions, read as the current one.

Every version has its schema, and a step to the next one. A chain composes the steps of each version into one Column
expression, so that records of all versions lie in one table, and a reader takes one pass. A record without a version is the oldest;
one from the future is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], dict[str, Column]]


@dataclass(frozen=True)
class Chain:
    """`schemas[v]`: the fields of version v as a DDL string, without the version; `steps[v]`: fields of version v + 1 from a struct of version v."""

    schemas: dict[int, str]
    steps: dict[int, Step]
    version: str = "SchemaVersion"

    def __post_init__(self) -> None:
        first, last = min(self.schemas), max(self.schemas)
        if sorted(self.schemas) != list(range(first, last + 1)) or sorted(self.steps) != list(range(first, last)):
            raise ValueError("a chain needs a schema for every version and a step from each but the last")

    @property
    def current(self) -> int:
        return max(self.schemas)

    def _struct(self, version: int, fields: Column | dict[str, Column]) -> Column:
        kind = ", ".join(f"`{n}`: {k}" for n, k in (f.strip().split(" ", 1) for f in _fields(self.schemas[version])))
        made = fields if isinstance(fields, Column) else F.struct(*(c.alias(n) for n, c in fields.items()))
        return made.cast(f"struct<{kind}>")

    def read(self, json: Column) -> Column:
        """A record (JSON) as a struct of the current version; null for what isn't JSON."""
        first = min(self.schemas)
        given = F.coalesce(F.try_to_number(F.get_json_object(json, f"$.{self.version}"), F.lit("999999")).cast("int"), F.lit(first))
        future = F.raise_error(F.concat(F.lit("unsupported schema version "), given.cast("string")))
        out = F.when(given > self.current, future.cast(self._type()))
        for version in range(first, self.current + 1):
            record = F.from_json(json, self.schemas[version])
            for step in range(version, self.current):
                record = _bound(record, self._stepped(step))
            here = given <= version if version == first else given == version
            out = out.when(here, F.when(F.get_json_object(json, "$").isNotNull(), self._struct(self.current, record)))
        return out

    def _stepped(self, step: int) -> Callable[[Column], Column]:
        return lambda r: self._struct(step + 1, self.steps[step](r))

    def _type(self) -> str:
        return "struct<" + ", ".join(f"`{n}`: {k}" for n, k in (f.strip().split(" ", 1) for f in _fields(self.schemas[self.current]))) + ">"


def _fields(ddl: str) -> list[str]:
    """The fields of a DDL string, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with `value` computed once."""
    return F.transform(F.array(value), f)[0]
