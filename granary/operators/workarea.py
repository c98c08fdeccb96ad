"""Work areas: open tables under aliases, each with a pointer, a filter, an order and relations; and the settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import commands as cmd
from granary.operators.ordering import RECNO


@dataclass
class Area:
    table: DataFrame
    at: int = 1
    filter: Column | None = None
    key: tuple | None = None
    orders: dict[str, list] = field(default_factory=dict)
    order: str | None = None
    relations: list[tuple] = field(default_factory=list)
    found: bool = False
    eof: bool = False
    bof: bool = False


class WorkAreas:
    """Commands on the current area. `tally` is the row count of the last command that reports one.

    Settings change what areas show: deleted hides deleted records, exact compares strings whole, near lets SEEK go on.
    Locking and optimising settings are taken and do nothing.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.areas, self.current, self.tally = spark, {}, "", 0
        self.settings = {"deleted": False, "exact": True, "near": False, "ansi": True, "unique": False, "null": True, "century": True, "lock": False, "multilocks": False, "exclusive": False, "optimize": True}

    def set(self, name: str, value) -> None:
        if name.lower() not in self.settings:
            raise KeyError(f"no such setting: {name}")
        self.settings[name.lower()] = value

    def use(self, table: DataFrame, alias: str, *keys: str) -> DataFrame:
        """USE table ALIAS alias; keys order its records unless it has numbers already."""
        t = table if RECNO in table.columns else cmd.as_table(table, *keys)
        self.areas[alias], self.current = Area(t), alias
        t.createOrReplaceTempView(alias)
        return t

    def select(self, alias: str) -> Area:
        if alias not in self.areas:
            raise KeyError(f"alias {alias} isn't open")
        self.current = alias
        return self.areas[alias]

    @property
    def area(self) -> Area:
        return self.areas[self.current]

    def close(self, alias: str | None = None) -> None:
        for a in [alias] if alias else list(self.areas):
            self.areas.pop(a, None)
            self.spark.catalog.dropTempView(a)

    def view(self) -> DataFrame:
        """The current table as the settings, its filter, its key range and its order show it."""
        a = self.area
        df = cmd.visible(a.table, self.settings["deleted"])
        if a.filter is not None:
            df = df.where(a.filter)
        if a.key:
            df = cmd.set_key(df, *a.key)
        return df.orderBy(*a.orders[a.order], RECNO) if a.order else df

    def set_filter(self, cond: Column | None = None) -> None:
        self.area.filter = cond

    def set_key(self, key: str, low=None, high=None) -> None:
        self.area.key = (key, low, high)

    def index_on(self, tag: str, *exprs: Column) -> None:
        self.area.orders[tag], self.area.order = list(exprs), tag

    def set_order(self, tag: str | None = None) -> None:
        if tag is not None and tag not in self.area.orders:
            raise KeyError(f"no such tag: {tag}")
        self.area.order = tag

    def _goto(self, found: DataFrame, past: str = "eof") -> bool:
        """Go to the record, or past an end: behind the last record, or onto the first one with BOF()."""
        row, a = found.select(RECNO).first(), self.area
        a.eof = a.bof = False
        if row is not None:
            a.at = row[0]
        elif past == "eof":
            a.eof, a.at = True, self.reccount() + 1
        elif past == "bof":
            a.bof = True
            self._goto(cmd.go(self.view(), "top"), "")
            a.bof = True
        return row is not None

    def locate(self, cond: Column) -> bool:
        self._last = cond
        self.area.found = self._goto(cmd.locate(self.view(), cond))
        return self.area.found

    def resume(self) -> bool:
        """CONTINUE."""
        self.area.found = self._goto(cmd.locate(self.view(), self._last, self.area.at))
        return self.area.found

    def seek(self, key: str, value) -> bool:
        hit = self._goto(cmd.seek(self.view(), key, value))
        if not hit and self.settings["near"]:
            self._goto(cmd.seek(self.view(), key, value, near=True))
        self.area.found = hit
        return hit

    def indexseek(self, key: str, value, move: bool = False) -> bool:
        """INDEXSEEK(): whether the key is there; the pointer moves on request only."""
        found = cmd.seek(self.view(), key, value)
        return self.seek(key, value) if move else not found.isEmpty()

    def go(self, where) -> bool:
        return self._goto(cmd.go(self.view(), where))

    def skip(self, n: int = 1) -> bool:
        return self._goto(cmd.skip(self.view(), self.area.at, n), "eof" if n > 0 else "bof")

    def equal(self, a: Column, b: str) -> Column:
        """`=` on strings: whole under SET EXACT ON, else up to the right side's length."""
        return a == b if self.settings["exact"] else a.startswith(b)

    def change(self, new: DataFrame) -> None:
        self.area.table = new
        new.createOrReplaceTempView(self.current)

    def count(self, cond: Column | None = None) -> int:
        df = self.view()
        self.tally = (df if cond is None else df.where(F.coalesce(cond, F.lit(False)))).count()
        return self.tally

    # state by name

    def recno(self) -> int:
        return self.area.at

    def reccount(self) -> int:
        """Of the whole table: filters and deleted marks don't count."""
        return self.area.table.count()

    def deleted(self) -> bool:
        row = cmd.scope_record(self.area.table, self.area.at).select(cmd.DELETED).first()
        return bool(row and row[0])

    def fields_of(self) -> list[str]:
        return [c for c in self.area.table.columns if c not in (RECNO, cmd.DELETED)]

    def lookup(self, ret: str, value, key: str):
        """LOOKUP(): the field of the first record shown whose key is the value, and go there; else past the end, empty."""
        rows = self.view().where(F.col(key) == F.lit(value)).orderBy(RECNO).select(RECNO, ret).limit(1)
        row = rows.first()
        self.area.found = self._goto(rows)
        return row[1] if row else ""

    def relation(self, n: int) -> str:
        return str(self.area.relations[n - 1][0]) if 0 < n <= len(self.area.relations) else ""


def _tag(w: WorkAreas, n: int) -> str:
    return list(w.area.orders)[n - 1] if 0 < n <= len(w.area.orders) else ""


#: The functions that tell a work area's state, by their names in the language; each takes the work areas first.
STATE = {
    "RECNO": WorkAreas.recno,
    "RECCOUNT": WorkAreas.reccount,
    "EOF": lambda w: w.area.eof,
    "BOF": lambda w: w.area.bof,
    "FOUND": lambda w: w.area.found,
    "DELETED": WorkAreas.deleted,
    "FCOUNT": lambda w: len(w.fields_of()),
    "FIELD": lambda w, n: w.fields_of()[n - 1].upper() if 0 < n <= len(w.fields_of()) else "",
    "AFIELDS": lambda w: [(n.upper(), w.area.table.schema[n].dataType.simpleString()) for n in w.fields_of()],
    "ALIAS": lambda w: w.current.upper(),
    "SELECT": lambda w: list(w.areas).index(w.current) + 1 if w.current in w.areas else 0,
    "USED": lambda w, alias=None: (w.current if alias is None else alias) in w.areas,
    "LOOKUP": WorkAreas.lookup,
    "SEEK": WorkAreas.seek,
    "INDEXSEEK": WorkAreas.indexseek,
    "ORDER": lambda w: (w.area.order or "").upper(),
    "TAG": lambda w, n: _tag(w, n).upper(),
    "TAGCOUNT": lambda w: len(w.area.orders),
    "TAGNO": lambda w: list(w.area.orders).index(w.area.order) + 1 if w.area.order else 0,
    "KEY": lambda w, n=1: ", ".join(str(c) for c in w.area.orders.get(_tag(w, n), [])),
    "FILTER": lambda w: "" if w.area.filter is None else str(w.area.filter),
    "RELATION": WorkAreas.relation,
    "SET": lambda w, name: w.settings[name.lower()],
}
