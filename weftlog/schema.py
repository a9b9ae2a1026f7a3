"""The object-centric event log: three tables, and checks of columns and arguments."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from weftlog.plans.tallies import OrderTally

EVENTS = ("eid", "ts", "activity")
OBJECTS = ("oid", "otype")
RELATIONS = ("eid", "oid", "otype", "activity", "ts")
FLAT = ("eid", "case_id", "activity", "ts")

#: Object types that executions and splits follow (fixed values).
STRUCTURAL_TYPES = ("orders", "items", "packages")


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> DataFrame:
    """df, or a ValueError that names the missing columns; costs no job."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def require_name(value: object, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must be a string that is not blank")
    return value.strip()


def require_ratio(value: float) -> float:
    """A share strictly between 0 and 1."""
    if not 0 < value < 1:
        raise ValueError("ratio must lie strictly between 0 and 1")
    return float(value)


def require_threshold(value: float, what: str = "threshold") -> float:
    """A number from 0 to 1, both included."""
    if not 0 <= value <= 1:
        raise ValueError(f"{what} must lie between 0 and 1")
    return float(value)


def normal_types(types: Iterable[object]) -> tuple[str, ...]:
    """Distinct stripped names in order; blanks and other things than strings are dropped."""
    out = sorted({t.strip() for t in types if isinstance(t, str) and t.strip()})
    if not out:
        raise ValueError("at least one object type is needed")
    return tuple(out)


@dataclass(frozen=True)
class ObjectLog:
    """events (eid, ts, activity), objects (oid, otype), relations (eid, oid, otype, qualifier, activity, ts).

    unique: whether events are known to have each id once; sub-logs keep that. distinct: whether relations are known
    to have each (eid, oid) once, with the activity of the event. lives, if any: (otype, oid, steps) of the objects of the types in ``traced``,
    whose steps (ts, eid, activity, alone) are all their events in order of ts and eid; alone tells that an event is known
    to have no other object of the type. around, if any: (exec_oid, items, packages, shared, events, objects), a row for each object of
    the first of STRUCTURAL_TYPES: the items that share an event with it and with no other one, the packages that share an event with
    those, ``shared`` the (package, item, events) of packages that share events with items of others too, with their number of events, and the events of all of them
    (ts, eid, activity), with the ``objects`` of each, (otype, oid), which are all if nothing is shared; sub-logs have none.
    tally, if any: counts of flows and variants without events and lives, of the same objects.
    """

    events: DataFrame
    objects: DataFrame
    relations: DataFrame
    unique: bool = False
    lives: DataFrame | None = None
    traced: tuple[str, ...] = ()
    distinct: bool = False
    around: DataFrame | None = None
    tally: OrderTally | None = None

    def checked(self) -> ObjectLog:
        require_columns(self.events, EVENTS, "events")
        require_columns(self.objects, OBJECTS, "objects")
        require_columns(self.relations, RELATIONS, "relations")
        return self

    def with_unique_events(self) -> ObjectLog:
        """The log with its event ids checked, once; a repeated one is an error."""
        if not self.unique and (repeated := self.events.groupBy("eid").count().where("count > 1").orderBy("eid").limit(1).collect()):
            raise ValueError(f"events has {repeated[0]['eid']} more than once")
        return replace(self, unique=True)

    def flat(self, otype: str) -> DataFrame:
        """The classic log of one object type: (eid, case_id, activity, ts), a case for each object.

        With lives it also has ``alone``: whether the event is known to have no other case."""
        r = self.relations.where(F.col("otype") == require_name(otype, "object type")).select("eid", F.col("oid").alias("case_id"), "activity", "ts", *(["alone"] if self.distinct and "alone" in self.relations.columns else []))
        return r if self.distinct else r.distinct()

    def once(self, *types: str) -> DataFrame:
        """(eid, oid, otype) of the relations of some types, or of all, without repetition."""
        r = self.relations.where(F.col("otype").isin(*types)) if types else self.relations
        r = r.select("eid", "oid", "otype")
        return r if self.distinct else r.distinct()

    def cases(self, otype: str) -> DataFrame | None:
        """(case_id, variant) of one object type from lives, or None without them."""
        if self.lives is None or require_name(otype, "object type") not in self.traced:
            return None
        return self.lives.where(F.col("otype") == otype.strip()).select(F.col("oid").alias("case_id"), F.transform("steps", lambda e: e["activity"]).alias("variant"))

    def of_objects(self, condition: Column) -> ObjectLog:
        """The sub-log of the relations of the objects whose oid and otype meet a condition; its events and objects stay."""
        return replace(self, around=None, relations=self.relations.where(condition), lives=None if self.lives is None else self.lives.where(condition), tally=None if self.tally is None else self.tally.of(condition))

    def restricted(self, oids: DataFrame) -> ObjectLog:
        """The sub-log of the relations of some objects (oid); objects without relations vanish."""
        oids = oids.select("oid").distinct()
        r = self.relations.join(oids, "oid", "left_semi")
        lives = None if self.lives is None else self.lives.join(oids, "oid", "left_semi")
        return replace(self, around=None, tally=None, events=self.events.join(r, "eid", "left_semi"), objects=self.objects.join(r, "oid", "left_semi"), relations=r.select(self.relations.columns), lives=lives)

    def structural(self, types: Iterable[str] = STRUCTURAL_TYPES) -> ObjectLog:
        """The sub-log of some object types. A type without objects or without relations is an error."""
        names = normal_types(types)
        there = {r["otype"] for r in self.objects.where(F.col("otype").isin(*names)).select("otype").distinct().collect()}
        if missing := sorted(set(names) - there):
            raise ValueError(f"no objects of type: {', '.join(missing)}")
        if self.around is not None and names == normal_types(STRUCTURAL_TYPES):
            # every event has an object of these types, and every object an event
            of = F.col("otype").isin(*names)
            return replace(self, objects=self.objects.where(of), relations=self.relations.where(of), lives=None if self.lives is None else self.lives.where(of), tally=None if self.tally is None else self.tally.of_types(names))
        sub = self.restricted(self.objects.where(F.col("otype").isin(*names)))
        left = {r["otype"] for r in sub.objects.select("otype").distinct().collect()}
        if lost := sorted(set(names) - left):
            raise ValueError(f"no related objects of type: {', '.join(lost)}")
        return sub
