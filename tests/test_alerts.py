"""Alerts of all kinds: tables against a loop, and a stream with its states against another."""

import datetime as dt
import random
from fractions import Fraction

import pytest

from siftline.streaming import alerts
from siftline.streaming.alerts import Rule

AT = dt.datetime(2024, 1, 1)
RULES = [
    Rule("high", "a", "threshold", "greater_than", 70.5),
    Rule("odd", "a", "anomaly", value=1.5, rows=12, least=4),
    Rule("rising", "a", "trend", "greater_than", 0.5, rows=6, least=3),
    Rule("both", "a", "composite", of=("odd", "high")),
    Rule("low", "b", "threshold", "less_than", 9.25),
    Rule("falling", "b", "trend", "less_than", -0.25, rows=9, least=2),
]


def breaks(rule, values, k, others):
    """By fractions: the mean, deviation and line of what stands before."""
    v = values[k]
    if rule.kind == "composite":
        return all(others[x] for x in rule.of)
    limit = Fraction(str(rule.value))
    if rule.kind == "threshold":
        return v > limit if rule.condition == "greater_than" else v < limit
    if rule.kind == "anomaly":
        last = values[max(0, k - rule.rows) : k]
        if len(last) < rule.least:
            return False
        mean = sum(last) / Fraction(len(last))
        return (v - mean) ** 2 > limit**2 * sum((x - mean) ** 2 for x in last) / len(last)
    last = values[max(0, k + 1 - rule.rows) : k + 1]
    if len(last) < max(rule.least, 2):
        return False
    x, y = Fraction(len(last) - 1, 2), sum(last) / Fraction(len(last))
    slope = sum((j - x) * (w - y) for j, w in enumerate(last)) / sum((j - x) ** 2 for j in range(len(last)))
    return slope > limit if rule.condition == "greater_than" else slope < limit


def made(n=600, seed=5):
    rng = random.Random(seed)
    rows, at = [], AT
    for k in range(n):
        at += dt.timedelta(milliseconds=rng.choice([0, 1500, 60_000, 60_000, 1_200_000]))
        rows.append((rng.choice("aab"), at, k, None if rng.random() < 0.03 else round(rng.uniform(0, 100) if k % 50 else 50.0, 2)))
    return rows


def loop(rows):
    values, out = {}, []
    for metric, _, event, value in sorted(rows, key=lambda r: (r[1], r[2])):
        if value is None:
            continue
        mine = values.setdefault(metric, [])
        mine.append(Fraction(str(value)))
        found = {}
        for r in [r for r in RULES if r.metric == metric]:
            found[r.name] = breaks(r, mine, len(mine) - 1, found)
        out.append((metric, event, found))
    return out


@pytest.mark.parametrize("block", [alerts.BLOCK, 40])
def test_alerts_of_tables_against_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(alerts, "BLOCK", block)
    rows = [*made(), ("c", AT, 10_000, 1.0)]
    df = spark.createDataFrame(rows, "metric string, at timestamp, event_id long, value double").repartition(3)
    want = loop(rows)
    assert {(r["rule"], r["event_id"]) for r in alerts.breaches(df, RULES).collect()} == {(n, e) for _, e, f in want for n, b in f.items() if b}
    last, changed = {}, set()
    for _, event, found in want:
        for name, broken in found.items():
            if broken != last.get(name, False):
                changed.add((name, event, "active" if broken else "resolved"))
            last[name] = broken
    assert {(r["rule"], r["event_id"], r["status"]) for r in alerts.changes(df, RULES).collect()} == changed
    assert {n for n, *_ in changed} == {r.name for r in RULES}
    assert alerts.breaches(df.limit(0), RULES).collect() == []


def states(rows, quiet):
    """One loop over measurements and commands, with silence between them."""
    state, last, values, out = {}, {}, {}, []

    def silence(metric, now):
        if metric in last and (now is None or now > last[metric] + quiet):
            for name in sorted(n for (m, n), s in state.items() if m == metric and s[1] in ("active", "acknowledged")):
                state[metric, name] = (state[metric, name][0], "resolved")
                out.append((metric, name, *state[metric, name], last[metric] + quiet, None))

    for metric, at, event, value, command, rule in sorted(rows, key=lambda r: (r[1], r[2])):
        silence(metric, at)
        if command:
            number, status = state.get((metric, rule), (0, None))
            if (command == "acknowledge" and status == "active") or (command == "resolve" and status in ("active", "acknowledged")):
                state[metric, rule] = (number, "acknowledged" if command == "acknowledge" else "resolved")
                out.append((metric, rule, *state[metric, rule], at, event))
        elif value is not None:
            last[metric] = at
            mine = values.setdefault(metric, [])
            mine.append(Fraction(str(value)))
            found = {}
            for r in [r for r in RULES if r.metric == metric]:
                found[r.name] = breaks(r, mine, len(mine) - 1, found)
                number, status = state.get((metric, r.name), (0, None))
                if found[r.name] != (status in ("active", "acknowledged")):
                    state[metric, r.name] = (number + 1, "active") if found[r.name] else (number, "resolved")
                    out.append((metric, r.name, *state[metric, r.name], at, event))
    return out, silence


def test_states_of_a_stream_against_a_loop(spark, tmp_path):
    rng = random.Random(9)
    quiet = dt.timedelta(minutes=15)
    rows = [(*r, None, None) for r in made(300, 6)]
    rows += [(m, at + dt.timedelta(milliseconds=7), 1000 + e, None, rng.choice(["acknowledge", "resolve"]), rng.choice([r.name for r in RULES])) for m, at, e, *_ in rows if rng.random() < 0.3]
    end = max(r[1] for r in rows) + dt.timedelta(days=1)  # moves the watermark past all timers
    kind = "metric string, at timestamp, event_id long, value double, command string, rule string"
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    for k in range(0, len(ordered), 100):
        spark.createDataFrame(ordered[k : k + 100], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for k in range(2):
        spark.createDataFrame([("end", end + dt.timedelta(days=k), 5000 + k, 1.0, None, None)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = alerts.alert_states(source, RULES, quiet)
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    finally:
        spark.conf.unset(provider)
    want, silence = states(rows, quiet)
    for metric in "ab":
        silence(metric, None)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[3] for r in got} == {"active", "acknowledged", "resolved"} and any(r[5] is None for r in got)


@pytest.mark.parametrize("wrong", [[Rule("x", "a", of=("y",), kind="composite")], [Rule("x", "a"), Rule("x", "a")], [Rule("x", "a"), Rule("y", "b", "composite", of=("x",))], [Rule("x", "a", "composite")]])
def test_rules_that_are_refused(wrong):
    with pytest.raises(ValueError, match="rule"):
        alerts.checked(wrong)
    with pytest.raises(ValueError, match="rule"):
        Rule("x", "a", "other")
