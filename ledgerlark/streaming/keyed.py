"""The billing fold's keyed state: typed, bounded by the watermark, with timers.

Per business the state store holds

* ``folded`` (a value): the subscription row and business status after all
  events that the watermark has passed;
* ``events`` (a list): the events it has not passed yet, and the
  ids of those it passed within the last ``remember`` milliseconds, by which a
  repeated delivery is told from a late one.

An event-time timer stands at the earliest of these; when the watermark passes
it, what is due is folded and what is forgotten dropped, whether or not the
business has new events.  So a business's state does not grow with the events
it has processed, and a quiet business settles too.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.schemas import schema

#: fields of the subscription row, and those that hold times (microseconds in the state)
BASE_FIELDS = ["id", "stripe_subscription_id", "stripe_customer_id", "status", "amount",
               "current_period_end", "card_last4", "card_brand", "payment_method",
               "cancel_at_period_end", "cancelled_at", "ended_at", "updated_at"]
EVENT_FIELDS = ["event_ts", "event_id", "kind", "status", "cancel_at_period_end", "stripe_subscription_id",
                "stripe_customer_id", "amount", "current_period_end", "card_last4", "card_brand"]


def _state_type(field: T.StructField) -> T.StructField:
    timed = isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType))
    return T.StructField(field.name, T.LongType() if timed else field.dataType)


_SUBS, _EVENTS = schema("subscriptions"), schema("billing_events")
FOLDED = T.StructType([T.StructField("row_exists", T.BooleanType())] + [_state_type(_SUBS[c]) for c in BASE_FIELDS]
                      + [T.StructField("business_status", T.StringType()), T.StructField("last_event", T.StringType()),
                         T.StructField("last_ts", T.LongType()), T.StructField("horizon", T.LongType()),
                         T.StructField("timer", T.LongType())])
LISTED = T.StructType([T.StructField("passed", T.BooleanType())]
                      + [T.StructField(c, T.StringType()) if c == "kind" else _state_type(_EVENTS[c]) for c in EVENT_FIELDS])


def plain(v, kind: T.DataType):
    """A pandas cell as a Python value of the field's type; every kind of
    missing is None (a column of whole numbers with missing ones comes as floats)."""
    if v is None or v is pd.NA or v != v:               # NaN and NaT differ from themselves
        return None
    return int(v) if isinstance(kind, T.LongType) else bool(v) if isinstance(kind, T.BooleanType) else v


def in_order(e: dict) -> tuple:
    return e["event_ts"], e["event_id"] or ""


class BillingFold(StatefulProcessor):
    """Folds one business's events in (event_ts, event_id) order.

    ``apply`` is the per-event rule on a dictionary with the keys row,
    business_status, last_event and last_ts; ``remember`` is how long, in
    milliseconds of event time behind the watermark, ids of folded events are kept.
    A business's first events bring its stored subscription row along (``stored``, JSON);
    rows come out as JSON too: a table of many columns for each business costs more than the fold.
    """

    def __init__(self, apply: Callable[[dict, dict], None], remember: int):
        self.apply, self.remember = apply, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", FOLDED)
        self.events = handle.getListState("events", LISTED)

    # ---- state ------------------------------------------------------------
    def _load(self) -> tuple[dict | None, list[dict]]:
        """The state (None for a business not met before) and its events in time order."""
        got = self.folded.get()
        if got is None:
            return None, []
        v = dict(zip(FOLDED.names, got))
        st = {"row": {c: v[c] for c in BASE_FIELDS} if v["row_exists"] else None,
              **{c: v[c] for c in ("business_status", "last_event", "last_ts", "horizon", "timer")}}
        return st, sorted((dict(zip(LISTED.names, e)) for e in self.events.get()), key=in_order)

    def _store(self, st: dict, listed: list[dict], new: list[dict] | None = None) -> None:
        """``new``: the events that were added, where nothing else about the list has changed."""
        due = None
        if listed:
            first = min(listed, key=lambda e: e["event_ts"] // 1000 + (self.remember if e["passed"] else 0))
            due = first["event_ts"] // 1000 + (self.remember if first["passed"] else 0)
        if due != st["timer"]:
            if st["timer"] is not None:
                self.handle.deleteTimer(st["timer"])
            if due is not None:
                self.handle.registerTimer(due)
            st["timer"] = due
        row = st["row"] or dict.fromkeys(BASE_FIELDS)
        self.folded.update((st["row"] is not None, *[row[c] for c in BASE_FIELDS],
                            *[st[c] for c in ("business_status", "last_event", "last_ts", "horizon", "timer")]))
        rows = [tuple(e[c] for c in LISTED.names) for e in (listed if new is None else new)]
        if new is None and rows:
            self.events.put(rows)
        elif new is None:
            self.events.clear()
        elif rows:
            self.events.appendList(rows)

    def _settle(self, st: dict, listed: list[dict], watermark: int) -> list[dict]:
        """Fold what the watermark (ms) has passed; returns the list without what is forgotten."""
        kept = []
        for e in listed:
            if not e["passed"] and watermark > 0 and e["event_ts"] <= watermark * 1000:
                self.apply(st, e)
                e = {**dict.fromkeys(LISTED.names), "passed": True, "event_ts": e["event_ts"], "event_id": e["event_id"]}
            if not e["passed"] or (e["event_id"] is not None and e["event_ts"] // 1000 + self.remember >= watermark):
                kept.append(e)
        if watermark > 0:
            st["horizon"] = max(st["horizon"] or 0, watermark * 1000)
        return kept

    # ---- rows -------------------------------------------------------------
    def _view(self, business: int, st: dict, listed: list[dict]) -> dict:
        """The state as if all events so far were folded."""
        view = {**st, "row": dict(st["row"]) if st["row"] else None}
        waiting = [e for e in listed if not e["passed"]]
        for e in waiting:
            self.apply(view, e)
        row = view["row"] or dict.fromkeys(BASE_FIELDS)
        return {"record": "state", "business_id": business, **row, "row_exists": view["row"] is not None,
                "subscription_status": view["business_status"], "event_id": view["last_event"],
                "event_ts": view["last_ts"], "waiting": len(waiting)}

    def _told(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({"told": [json.dumps(r) for r in rows]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        business, watermark = int(key[0]), timerValues.getCurrentWatermarkInMs()
        st, listed = self._load()
        begun, new = st is not None, []
        known = {e["event_id"] for e in listed} - {None}        # events without an id are never the same one
        kinds = [LISTED[c].dataType for c in EVENT_FIELDS]
        rejected = []
        for pdf in rows:
            if st is None:
                stored = plain(pdf["stored"].iloc[0], T.StringType())
                st = {"row": json.loads(stored) if stored else None,
                      **dict.fromkeys(("business_status", "last_event", "last_ts", "horizon", "timer"))}
            for values in zip(*[pdf[c].tolist() for c in EVENT_FIELDS]):
                e = {"passed": False, **dict(zip(EVENT_FIELDS, map(plain, values, kinds)))}
                if e["event_id"] in known:
                    why = "duplicate"
                elif st["horizon"] is not None and e["event_ts"] <= st["horizon"]:
                    why = "late"
                else:
                    if e["event_id"] is not None:
                        known.add(e["event_id"])
                    new.append(e)
                    continue
                rejected.append({"record": why, "business_id": business, "event_id": e["event_id"], "event_ts": e["event_ts"]})
        every = sorted([*listed, *new], key=in_order)
        listed = self._settle(st, every, watermark)
        same = len(listed) == len(every) and all(a is b for a, b in zip(listed, every))
        self._store(st, listed, new if begun and same else None)
        yield self._told([self._view(business, st, listed), *rejected])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        st, listed = self._load()
        before = sum(not e["passed"] for e in listed)
        st["timer"] = None                                      # it has gone off
        listed = self._settle(st, listed, timerValues.getCurrentWatermarkInMs())
        self._store(st, listed)
        if before:
            yield self._told([self._view(int(key[0]), st, listed)])

    def close(self) -> None:
        pass
