import datetime as dt
import random

import pytest

from folioflow.operators import windows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def limiter(times, minute_limit, hour_limit):
    """The sequential rule, one request at a time."""
    out, minute, hour = [], None, None
    for now in times:
        if minute is None:
            minute, hour = [0, now + 60], [0, now + 3600]
        if now > minute[1]:
            minute = [0, now + 60]
        elif minute[0] >= minute_limit:
            out.append(windows.MINUTE_DENIED)
            continue
        if now > hour[1]:
            hour = [0, now + 3600]
        elif hour[0] >= hour_limit:
            out.append(windows.HOUR_DENIED)
            continue
        minute[0] += 1
        hour[0] += 1
        out.append(None)
    return out


@pytest.mark.parametrize("minute_limit,hour_limit", [(3, 20), (60, 1000), (1, 2), (5, 3)])
def test_anchored_limit_equals_the_sequential_rule(spark, minute_limit, hour_limit):
    rng = random.Random(minute_limit)
    rows, want = [], {}
    for key in ("hot", "mild", "rare"):
        at, times = 0, []
        for _ in range({"hot": 1500, "mild": 200, "rare": 10}[key]):
            at += rng.choice({"hot": [0, 0, 1, 2, 9], "mild": [0, 5, 61, 400], "rare": [4000]}[key])
            times.append(at)
        for i, (t, verdict) in enumerate(zip(times, limiter(times, minute_limit, hour_limit), strict=True)):
            want[(key, i)] = verdict
            rows.append((key, i, T0 + dt.timedelta(seconds=t)))
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "key string, id int, ts timestamp")
    out = windows.rate_limit_anchored(log, "key", "ts", "id", minute_limit, hour_limit).collect()
    assert {(r.key, r.id): r.reason for r in out} == want
    assert all(r.is_allowed == (r.reason is None) for r in out)


def turns(spark, *rows):
    return spark.createDataFrame(
        [(c, t, r, f"{r} {c}.{t}") for c, t, r in rows], "conv_id long, turn long, role string, text string"
    )


def test_pairs_follow_parity_after_the_system_turn(spark):
    df = turns(
        spark,
        (1, 0, "system"), (1, 1, "human"), (1, 2, "gpt"), (1, 3, "user"), (1, 4, "assistant"),
        (2, 0, "user"), (2, 1, "user"), (2, 2, "assistant"), (2, 3, "assistant"),
        (3, 0, "user"),
        (4, 0, "User"), (4, 1, "GPT"), (4, 2, "user"),
        (5, 0, "system"), (5, 1, "assistant"), (5, 2, "user"), (5, 3, "assistant"),
    )
    got = {(r.conv_id, r.turn, r.system_text) for r in windows.pair_turns(df).collect()}
    assert got == {(1, 1, "system 1.0"), (1, 3, "system 1.0"), (4, 0, "")}


def test_trim_keeps_system_and_newest(spark):
    df = spark.createDataFrame(
        [
            (1, 0, "system", "System prompt"),
            (1, 1, "user", "User question 1"),
            (1, 2, "ai", "AI response 1"),
            (1, 3, "user", "User question 2"),
            (1, 4, "ai", "AI response 2"),
        ],
        "conv_id long, turn long, role string, text string",
    )
    kept = [(r.role, r.text) for r in windows.trim_context(df, 6).orderBy("turn").collect()]
    assert kept == [("system", "System prompt"), ("user", "User question 2"), ("ai", "AI response 2")]


def test_cache_hits_renew_the_entry(spark):
    rows = [("q", i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 7200, 14400, 21601, 21601])]
    log = spark.createDataFrame(rows, "query string, id int, ts timestamp")
    out = {r.id: r.is_hit for r in windows.cache_verdict(log, "query", "ts", "id").collect()}
    assert out == {0: False, 1: True, 2: True, 3: False, 4: True}


def test_positions_close_gaps(spark):
    df = turns(spark, (1, 0, "user"), (1, 300, "assistant"), (1, 999, "user"))
    got = [r.position for r in windows.positions(df, "conv_id", "turn").orderBy("turn").collect()]
    assert got == [0, 1, 2]
