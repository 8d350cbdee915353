"""Conversation repair, repetition rules and resampling against plain Python."""

import hashlib
import heapq
import itertools
import math
import random
import zlib
from collections import Counter

import llm_cases
import pytest

from folioflow.llm import conversations, importance, repetition, viterbi, wordhash
from folioflow.session import table

SPACES = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """(initial, truncated, must go) of each row -> cost and ASCII-least cheapest audit, by search."""
    n = len(rows)
    best = {}
    heap = [(0, "", 0, 0)]
    after = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
    letter = {1: "s", 2: "u", 3: "a"}
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if best.get((i, q), (cost, audit)) < (cost, audit) or ((i, q) in best and best[i, q] == "done"):
            continue
        best[i, q] = (cost, audit)
        if i == n and q in (0, 3):
            return cost, audit
        moves = []
        for to in after[q]:
            if to != 1:
                moves.append((cost + 3, audit + "I", i, to))
        if i < n:
            kind, truncated, gone = rows[i]
            moves.append((cost + 4, audit + "D", i + 1, q))
            if not gone:
                for to in after[q]:
                    if to != 1:
                        moves.append((cost + 3 + 3 * truncated, audit + "R", i + 1, to))
                    if letter[to] == kind:
                        moves.append((cost + 3 * truncated, audit + "K", i + 1, to))
        for m in moves:
            if (m[2], m[3]) not in best or (m[0], m[1]) < best[m[2], m[3]]:
                best[m[2], m[3]] = (m[0], m[1])
                heapq.heappush(heap, m)


def plain_repair(rows):
    talks = {}
    for conv, turn, role, text in rows:
        held = talks.setdefault(conv, [])
        shown = [" " if x is None else x for x in (conv, turn)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        role = "user" if kind == 4 else role
        held += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, held in talks.items():
        held.sort(
            key=lambda r: (
                r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()
            )
        )
        seen, faults, marks = set(), Counter(), []
        for _, role, text in held:
            shown = text.rstrip(SPACES)
            fault = (
                "blank" if not shown else "duplicate" if (role, text) in seen
                else "truncated" if shown[-1] not in ".!?" else ""
            )
            seen.add((role, text))
            faults[fault] += 1
            marks.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        turns = {t for t, _, _ in held if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        cost, audit = plain_edits(marks)
        lines, at, q = [], 0, 0
        for letter in audit:
            named = "assistant" if q == 2 else "user"
            if letter == "I":
                lines.append(f"{named}:")
                q = 3 if q == 2 else 2
                continue
            _, role, text = held[at]
            at += 1
            if letter == "R":
                lines.append(f"{named}:{text}")
                q = 3 if q == 2 else 2
            elif letter == "K":
                lines.append(f"{role}:{text}")
                q = {"s": 1, "u": 2, "a": 3}[role[0]]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return out


def talks(seed, n, most=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "über"])
            text = rng.choice(["Yes.", "no", "Why?", "", " \t", None, f"text {rng.random()}.", f"open {rng.random()}", "é!\x85"])
            turn = rng.choice([turn, turn, turn, turn + 3, None, -turn])
            rows.append((conv if conv else None, turn, role, text))
    rows += rows[:3]
    return rows


def sorted_rows(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("seed", range(40))
def test_chunks_give_what_the_whole_gives(seed):
    rng = random.Random(seed)
    kinds = rng.choice(["sua-", "ua", "-", "u", "s-", "ua-"])
    signs = [viterbi.symbol(rng.choice(kinds), rng.random() < 0.3) for _ in range(rng.randint(0, 60))]
    want = [(viterbi.KINDS[s >> 1], s & 1, False) for s in signs]
    cost, audit = plain_edits(want)
    vectors, constants = viterbi.backwards(signs)
    assert constants[-1] + vectors[-1][viterbi.START] == cost
    cuts = sorted(rng.randint(0, len(signs)) for _ in range(3))
    chunks = [signs[a:z] for a, z in zip([0, *cuts], [*cuts, len(signs)], strict=True)]
    vector, ways, entered, total = viterbi.NUMBER[viterbi.END], [], [], 0
    for chunk in reversed(chunks):
        way = viterbi.summary(chunk)[vector]
        ways.append(way)
        entered.append(vector)
        vector, total = way[0], total + way[1]
    assert total + viterbi.VECTORS[vector][viterbi.START] == cost
    state, letters = viterbi.START, ""
    for chunk, way, vector in zip(chunks, reversed(ways), reversed(entered), strict=True):
        letters += "".join(viterbi.trace(chunk, viterbi.VECTORS[vector], state))
        state = way[2][state]
    assert letters + viterbi.CLOSING[state] == audit


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_repair(spark, parts):
    rows = talks(7, 40)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    frame = frame.selectExpr("*", "1 AS part", "'x' AS name", "2 AS kind", "3 AS seq", "4 AS `a.b`", "5 AS dropped")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = conversations.repair(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted_rows(got) == sorted_rows(plain_repair(rows))
    assert conversations.repair(frame.limit(0)).count() == 0


def test_one_conversation_over_many_ranges(spark):
    """Its rows are dealt over 23 ranges: tools, copies and blanks, which never let vectors meet."""
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["tool", "user", "assistant"]), rng.choice(["Same.", "open", "", f"{t}."])) for t in range(900)]
    rows += [(5, t, "tool", "z") for t in range(900, 1200)] + [(5, None, "tool", "twice!")] * 200
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = conversations.repair(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted_rows(got) == sorted_rows(plain_repair(rows))


def test_repair_of_the_table(spark, small):
    frame = table(spark, small, "conversations")
    want = plain_repair([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    got = conversations.repair(frame).collect()
    assert sorted_rows(got) == sorted_rows(want) and any(r.cost for r in got)


def plain_rules(text):
    words = (text or "").encode().split()
    n = len(words)
    chars = sum(len(w.decode()) for w in words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    phrases = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    again = set()
    for i in range(n - 2):
        if phrases[tuple(words[i : i + 3])] > 1:
            again.update(range(i, i + 3))
    covered, maximal = set(), []
    for size in range(repetition.REPEAT, n):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        repeats = [p for p in places.values() if len(p) > 1]
        if not repeats:
            break
        for p in repeats:
            for i in p:
                covered.update(range(i, i + size))
            left = {words[i - 1] if i else i - 1 for i in p}
            right = {words[i + size] if i + size < n else i for i in p}
            if len(left) > 1 and len(right) > 1:
                maximal.append(size)
    failed = n < 50 or 100 * len(again) > 50 * n
    kept = not failed and len(covered) <= 0.3 * n and max(maximal, default=0) <= 200
    return (
        n, chars, symbols, len(lines) - len(set(lines)), len(again), failed, kept,
        len(maximal), max(maximal, default=0), len(covered),
    )


def test_measures_of_short_texts():
    import numpy as np

    rng = random.Random(1)
    texts = []
    for _ in range(150):
        base = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 50))]
        texts.append(" ".join(base * rng.choice([1, 1, 2])))
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = repetition.measures(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, text in enumerate(texts):
        want = plain_rules(text)
        assert tuple(int(found[m][i]) for m in repetition.MEASURES) == (*want[:5], *want[7:]), text


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_repetition_rules(spark, block, monkeypatch):
    monkeypatch.setattr(wordhash, "BLOCK_BYTES", block)
    extra = [
        (50, "#x y\nx y\n \nx y\n* * <b>", None, None, 1),
        (51, llm_cases.prose(21, 300) + " " + llm_cases.prose(22, 250) + " " + llm_cases.prose(22, 250), None, None, 1),
        (52, llm_cases.prose(23, 900) + " " + llm_cases.prose(24, 90) + " end " + llm_cases.prose(24, 90), None, None, 1),
    ]
    docs = llm_cases.awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.createDataFrame(extra, llm_cases.SHAPE)).filter("doc_id IS NULL OR doc_id NOT IN (8, 20)")
    got = repetition.judge(docs.selectExpr("*", "1 AS kept", "2 AS n_words"))
    want = [(r[0], *plain_rules(r[1])) for r in [*llm_cases.rows(), *extra] if r[0] not in (8, 20)]
    assert sorted_rows(got.collect()) == sorted_rows(want)
    assert {r.doc_id for r in got.filter("kept").collect()} >= {2, 52} and got.filter("doc_id = 51 AND kept").count() == 0
    assert repetition.judge(llm_cases.empty(spark)).count() == 0


def test_repetition_rules_on_a_table(spark, small):
    docs = table(spark, small, "documents").filter("char_length(text) < 20000")
    got = {r.doc_id: tuple(r)[1:] for r in repetition.judge(docs).collect()}
    assert got == {r.doc_id: plain_rules(r.text) for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
    fine = [v[6] for k, v in got.items() if quality.get(k) == 1 and not v[5]]
    assert sum(fine) >= 0.99 * len(fine)


def plain_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c.isascii() and c.isalnum() or ord(c) >= 0x80 else " " for c in low).split(" ")
    words = [w for w in words if w]
    return words, [*words, *(f"{a} {b}" for a, b in itertools.pairwise(words))]


def plain_draw(docs, target, percent, least):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, plain_features(text)[1]))
    for text in target:
        t.update(map(bucket, plain_features(text)[1]))
    all_s, all_t = s.total(), t.total()
    out = []
    for key, text in docs:
        words, found = plain_features(text)
        gain = [
            math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
            for b in map(bucket, found)
        ]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None, len(words) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_resample(spark, percent):
    docs = llm_cases.awkward(spark).selectExpr("*", "1 AS able", "2 AS salt", "3 AS `rank`", "4 AS score")
    target = spark.createDataFrame([("Mi ra-tu lo", 1), (None, 2), ("mi ra", 3)], "text string, doc_id int")
    got = importance.resample(docs, target, percent)
    want = plain_draw([(r[0], r[1]) for r in llm_cases.rows()], ["Mi ra-tu lo", None, "mi ra"], percent, 20)
    assert sorted_rows(got.collect()) == sorted_rows(want)
    assert importance.resample(llm_cases.empty(spark), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == len(want)


def test_resample_of_a_table(spark, small):
    docs, target = table(spark, small, "documents"), table(spark, small, "benchmark")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain_draw(rows, [r.text for r in target.collect()], 25, 20)
    assert sorted_rows(importance.resample(docs, target).collect()) == sorted_rows(want)
