"""Alerts on metrics: thresholds, anomalies, trends and composites of them, with states.

A rule is broken by a measurement (metric, at, event_id, value), in the order of time and id within its metric:

* ``threshold``: the value is over (``greater_than``) or under (``less_than``) the rule's;
* ``anomaly``: it is further from the mean of the last ``rows`` measurements before it than ``value`` standard deviations of theirs;
* ``trend``: the line through the last ``rows`` measurements, this one included, rises by more, or by less, than ``value`` a measurement;
* ``composite``: all of the rules named in ``of``, which are of the same metric, are broken.

Anomalies and trends need ``least`` measurements. Values count in ten-thousandths, as whole numbers, so that sums are exact in any
order and batches, streams and SQL agree to the row. A null value is no measurement.

An alert of a rule is active from the measurement that breaks it, acknowledged if someone says so, and resolved by the first
measurement that doesn't break it, by command, or by silence: ``quiet`` after the metric's last measurement.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftline.operators.windows import row_numbers

SCALE = 10_000
KINDS = ("threshold", "anomaly", "trend", "composite")
#: Measurements of a metric are numbered, and taken so many a task at a time, with those that windows need before them.
BLOCK = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    kind: str = "threshold"
    condition: str = "greater_than"
    value: float = 0.0
    rows: int = 50
    least: int = 10
    of: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.condition not in ("greater_than", "less_than") or not 1 <= self.least <= self.rows:
            raise ValueError(f"no such rule: {self}")

    @property
    def limit(self) -> int:
        """In ten-thousandths; of deviations in hundredths, squared."""
        return round(self.value * 100) ** 2 if self.kind == "anomaly" else round(self.value * SCALE)


def checked(rules: list[Rule]) -> list[Rule]:
    """Rules with the parts of a composite before it."""
    done: dict[str, Rule] = {}
    for rule in rules:
        if rule.name in done or any(x not in done or done[x].metric != rule.metric for x in rule.of) or (rule.kind == "composite") != bool(rule.of):
            raise ValueError(f"a rule's name is new, and a composite's parts come before it: {rule}")
        done[rule.name] = rule
    return list(done.values())


# over tables


def _moments(rows: int) -> dict[str, Column]:
    """Sums over the measurements before this one, and over those up to it with their places in the window from 0."""
    within = W.partitionBy("metric", "__block").orderBy("__n")
    before, here = within.rowsBetween(-rows, -1), within.rowsBetween(1 - rows, 0)
    v, first = F.col("__v"), F.min("__n").over(here)
    return {
        f"__n{rows}": F.count(v).over(before),
        f"__s{rows}": F.sum(v).over(before),
        f"__q{rows}": F.sum(v * v).over(before),
        f"__m{rows}": F.count(v).over(here),
        f"__t{rows}": F.sum(v).over(here),
        f"__x{rows}": F.sum(v * F.col("__n")).over(here) - first * F.sum(v).over(here),
    }


def _broken(rule: Rule, others: dict[str, Column]) -> Column:
    def whole(name: str) -> Column:
        return F.col(f"__{name}{rule.rows}").cast("decimal(20,0)")

    v, limit = F.col("__v"), F.lit(rule.limit).cast("decimal(20,0)")
    over = rule.condition == "greater_than"
    if rule.kind == "composite":
        found = F.lit(True)
        for x in rule.of:
            found = found & others[x]
    elif rule.kind == "threshold":
        found = v > limit if over else v < limit
    elif rule.kind == "anomaly":
        apart = whole("n") * v - whole("s")
        found = (whole("n") >= rule.least) & ((apart * apart).cast("decimal(34,0)") * 10_000 > (whole("n") * whole("q") - whole("s") * whole("s")).cast("decimal(30,0)") * limit)
    else:
        n = whole("m")  # the places' sum is n (n - 1) / 2, that of their squares n (n - 1) (2 n - 1) / 6
        rise = (n * whole("x") * 12 - n * (n - 1) * whole("t") * 6).cast("decimal(38,0)")
        level = (n * n * (n - 1) * (n + 1)).cast("decimal(18,0)") * limit
        found = (n >= rule.least) & (n > 1) & (rise > level if over else rise < level)
    return F.coalesce((F.col("metric") == rule.metric) & found, F.lit(False))


def _judged(metrics: DataFrame, rules: list[Rule]) -> DataFrame:
    """Measurements of metrics with rules, with ``broken``, a map of rule to whether it is broken, and ``before``, that of the one before.

    No task has a whole metric: rows are numbered by ranges, and a block borrows the rows that its windows reach back to.
    """
    rules = checked(rules)
    scaled = F.round(F.col("value").cast("decimal(30,10)") * SCALE).cast("decimal(20,0)")
    known = metrics.filter(F.col("metric").isin(sorted({r.metric for r in rules})) & F.col("value").isNotNull())
    numbered = row_numbers(known.select("metric", "at", "event_id", scaled.alias("__v")), ["at", "event_id"], ["metric"])
    reach = max([r.rows for r in rules], default=1) + 1
    own = numbered.withColumn("__block", F.floor((F.col("__n") - 1) / BLOCK))
    lead = own.filter((F.col("__n") - 1) % BLOCK >= BLOCK - reach).withColumn("__block", F.col("__block") + 1)
    both = own.withColumn("__own", F.lit(True)).unionByName(lead.withColumn("__own", F.lit(False)))
    for rows in sorted({r.rows for r in rules}):
        both = both.withColumns(_moments(rows))
    broken: dict[str, Column] = {}
    for rule in rules:
        broken[rule.name] = _broken(rule, broken)
    mine = [F.struct(F.lit(r.name).alias("rule"), broken[r.name].alias("broken"), F.lit(r.metric).alias("of")) for r in rules]
    listed = both.withColumn("broken", F.filter(F.array(*mine), lambda x: x["of"] == F.col("metric")))
    mapped = listed.withColumn("broken", F.map_from_entries(F.transform("broken", lambda x: F.struct(x["rule"], x["broken"]))))
    before = F.lag("broken").over(W.partitionBy("metric", "__block").orderBy("__n"))
    return mapped.withColumn("before", before).filter("__own").select("metric", "at", "event_id", "broken", "before")


def breaches(metrics: DataFrame, rules: list[Rule]) -> DataFrame:
    """(metric, rule, event_id, at) for each measurement that breaks a rule."""
    found = _judged(metrics, rules).select("metric", "at", "event_id", F.explode("broken").alias("rule", "broken"))
    return found.filter("broken").select("metric", "rule", "event_id", "at")


def changes(metrics: DataFrame, rules: list[Rule]) -> DataFrame:
    """(metric, rule, event_id, at, status): where alerts become active and, by a measurement, resolved."""
    found = _judged(metrics, rules).select("metric", "at", "event_id", "before", F.explode("broken").alias("rule", "broken"))
    changed = found.filter(F.col("broken") != F.coalesce(F.col("before")[F.col("rule")], F.lit(False)))
    return changed.select("metric", "rule", "event_id", "at", F.when(F.col("broken"), "active").otherwise("resolved").alias("status"))


# over streams

STATES = "metric string, rule string, number long, status string, at timestamp, event_id long"
OPEN = ("active", "acknowledged")


def broken_rules(rules: list[Rule], recent: list[int], v: int) -> dict[str, bool]:
    """Whether a measurement breaks each rule, after the ``recent`` ones."""
    found: dict[str, bool] = {}
    for r in rules:
        over = r.condition == "greater_than"
        if r.kind == "composite":
            found[r.name] = all(found[x] for x in r.of)
        elif r.kind == "threshold":
            found[r.name] = v > r.limit if over else v < r.limit
        elif r.kind == "anomaly":
            last = recent[-r.rows :]
            n, s, q = len(last), sum(last), sum(x * x for x in last)
            found[r.name] = n >= r.least and (n * v - s) ** 2 * 10_000 > (n * q - s * s) * r.limit
        else:
            last = [*recent, v][-r.rows :]
            n = len(last)
            rise = 12 * n * sum(k * x for k, x in enumerate(last)) - 6 * n * (n - 1) * sum(last)
            level = n * n * (n - 1) * (n + 1) * r.limit
            found[r.name] = n >= r.least and n > 1 and (rise > level if over else rise < level)
    return found


class Alerts(StatefulProcessor):
    """A metric's state: its last measurements, and of each rule the number and status of its last alert."""

    def __init__(self, rules: list[Rule], quiet: timedelta):
        self.rules, self.quiet = rules, int(quiet.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "v long")
        self.last = handle.getValueState("last", "ms long")
        self.alerts = handle.getMapState("alerts", "rule string", "number long, status string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        mine = [r for r in self.rules if r.metric == key[0]]
        recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        state = {k[0]: tuple(v) for k, v in self.alerts.iterator()} if self.alerts.exists() else {}
        reach = max([r.rows for r in mine], default=0)
        out: list[tuple] = []
        given = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for at, event, value, command, named in zip(given["at"], given["event_id"], given["value"], given["command"], given["rule"], strict=True):
            ms = int(at.value // 1_000_000)
            if last is not None and ms > last + self.quiet:
                out += self._silent(key[0], state, last)
            if isinstance(command, str):
                number, status = state.get(named, (0, None))
                if command == "acknowledge" and status == "active" or command == "resolve" and status in OPEN:
                    state[named] = (number, "acknowledged" if command == "acknowledge" else "resolved")
                    out.append((key[0], named, *state[named], at, event))
            elif value == value and value is not None:
                v, last = round(value * SCALE), ms
                for rule, broken in broken_rules(mine, recent, v).items():
                    number, status = state.get(rule, (0, None))
                    if broken != (status in OPEN):
                        state[rule] = (number + 1, "active") if broken else (number, "resolved")
                        out.append((key[0], rule, *state[rule], at, event))
                recent = [*recent, v][-reach:] if reach else []
        if recent:  # Spark refuses to store an empty list
            self.recent.put([(v,) for v in recent])
        for rule, alert in state.items():
            self.alerts.updateValue((rule,), alert)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if last is not None:
            self.last.update((last,))
            if any(status in OPEN for _, status in state.values()):
                self.handle.registerTimer(last + self.quiet)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = {k[0]: tuple(v) for k, v in self.alerts.iterator()}
        out = self._silent(key[0], state, self.last.get()[0])
        for rule, alert in state.items():
            self.alerts.updateValue((rule,), alert)
        yield self._frame(out)

    def _silent(self, metric: str, state: dict[str, tuple], last: int) -> list[tuple]:
        """Alerts that silence resolves, in the order of their names."""
        at, out = pd.Timestamp(last + self.quiet, unit="ms"), []
        for rule in sorted(state):
            number, status = state[rule]
            if status in OPEN:
                state[rule] = (number, "resolved")
                out.append((metric, rule, number, "resolved", at, None))
        return out

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["metric", "rule", "number", "status", "at", "event_id"])
        return frame.astype({"number": "int64", "event_id": "Int64"})


def alert_states(inputs: DataFrame, rules: list[Rule], quiet: timedelta, late: str = "1 hour") -> DataFrame:
    """The changes of alerts on a stream: metric, rule, number (of the rule's alert, from 1), status, at, event_id (null: silence).

    Columns: metric, at, event_id, value; and for commands, which have no value, command (acknowledge, resolve) and rule. Times are whole
    milliseconds, rows at most ``late``. Wants the RocksDB state store.
    """
    given = inputs.select("metric", F.col("at").cast("timestamp").alias("at"), "event_id", F.col("value").cast("double").alias("value"), "command", "rule")
    watched = given.withWatermark("at", late).groupBy("metric")
    return watched.transformWithStateInPandas(Alerts(checked(rules), quiet), STATES, "append", "eventTime")
