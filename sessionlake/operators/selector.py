"""Selectors: what part of a source a load or a query is about."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("all", "date_range", "cwd", "cwd_date_range")


class InvalidSelector(ValueError):
    pass


@dataclass(frozen=True)
class Selector:
    kind: str
    root: str
    cwd: str | None = None
    from_date: str | None = None
    to_date: str | None = None

    @classmethod
    def parse(cls, text: str) -> Selector:
        try:
            x = json.loads(text)
        except ValueError as e:
            raise InvalidSelector(f"not JSON: {e}") from e
        if not isinstance(x, dict) or x.get("kind") not in KINDS:
            raise InvalidSelector(f"kind must be one of {', '.join(KINDS)}")
        return cls(x["kind"], x.get("root") or "", x.get("cwd"), x.get("fromDate"), x.get("toDate")).canonical()

    def canonical(self) -> Selector:
        if not isinstance(self.root, str) or not self.root.strip():
            raise InvalidSelector("root is required")
        root = os.path.abspath(os.path.expanduser(self.root.strip()))
        cwd = start = end = None
        if "cwd" in self.kind:
            cwd = (self.cwd or "").strip()
            if not cwd:
                raise InvalidSelector("cwd is required")
        if "date" in self.kind:
            start, end = (self.from_date or "").strip(), (self.to_date or "").strip()
            if not all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) for x in (start, end)):
                raise InvalidSelector("dates are YYYY-MM-DD")
            if start > end:
                raise InvalidSelector("fromDate is after toDate")
        return Selector(self.kind, root, cwd, start, end)

    def key(self) -> str:
        x = {"kind": self.kind, "root": self.root}
        x |= {"cwd": self.cwd} if self.cwd is not None else {}
        x |= {"fromDate": self.from_date, "toDate": self.to_date} if self.from_date is not None else {}
        return json.dumps(x, separators=(",", ":"), ensure_ascii=False)

    def predicate(self, path: str = "file_path", cwd: str = "cwd", date: str = "path_date") -> Column:
        p = (F.col(path) == self.root) | F.col(path).startswith(self.root.rstrip("/") + "/")
        if self.cwd is not None:
            p = p & (F.col(cwd) == self.cwd)
        if self.from_date is not None:
            p = p & F.col(date).between(self.from_date, self.to_date)
        return p

    def columns(self) -> dict[str, Column]:
        return {"kind": F.lit(self.kind), "root": F.lit(self.root), "cwd": F.lit(self.cwd).cast("string"), "from_date": F.lit(self.from_date).cast("string"), "to_date": F.lit(self.to_date).cast("string")}


def implies(have, want) -> Column:
    """Does coverage of ``have`` answer ``want``? Both map names of Selector's fields to columns."""
    dates = (have["from_date"] <= want["from_date"]) & (have["to_date"] >= want["to_date"])
    same_cwd = have["cwd"].eqNullSafe(want["cwd"]) & want["cwd"].isNotNull()
    answer = (
        F.when(have["kind"] == "all", True)
        .when(have["kind"] == "date_range", want["kind"].isin("date_range", "cwd_date_range") & dates)
        .when(have["kind"] == "cwd", want["kind"].isin("cwd", "cwd_date_range") & same_cwd)
        .otherwise((want["kind"] == "cwd_date_range") & same_cwd & dates)
    )
    return (have["root"] == want["root"]) & F.coalesce(answer, F.lit(False))
