"""Repair of turns against a search over all edits, in segments of several lengths, and its edge cases."""

import hashlib
import heapq
import random
import zlib

from draftlens.llm import repair

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def said(value):
    return " " if value is None else str(value)


def damage(rows):
    """Rows (conv_id, turn, role, text) after damage, by conversation and in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        hit = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if hit == 1 else text.translate(str.maketrans("", "", ".!?")) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    for own in out.values():
        own.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode()))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns) by a search in order of (cost, audit)."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, turns = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, turns
        fits = lambda n, last=last: last + n in ("s", "u", "su", "ua", "au")
        for n, name in (("u", "user"), ("a", "assistant")):
            if fits(n):
                heapq.heappush(heap, (cost + 5, audit + "I", i, n, (*turns, (name, ""))))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, turns))
        if faults[i] in ("blank", "duplicate"):
            continue
        extra = 5 if faults[i] == "truncated" else 0
        if role[:1] and fits(role[:1]):
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*turns, (role, text))))
        for n, name in (("u", "user"), ("a", "assistant")):
            if fits(n):
                heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, n, (*turns, (name, text))))


def plain(rows):
    out = {}
    for conv, own in damage(rows).items():
        seen, faults = set(), []
        for _, role, text in own:
            end = text.rstrip(BLANKS)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, kept = cheapest(own, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def made_up(seed, n):
    rnd = random.Random(seed)
    texts = lambda: rnd.choice([None, "", " \n", "Hi.", "ok?", "cut", "Yes! "] + [f"{rnd.randrange(40)}{e}" for e in ("", ".", "!", "?")])
    roles = [None, "", "user", "assistant", "system", "tool", "user", "assistant"]
    rows = [(rnd.choice([None, 1, 2, 3] + [7] * 6), rnd.choice([None, *range(n // 3)]), rnd.choice(roles), texts()) for _ in range(n)]
    rows += [(9, 5, "user", "a.")] * 300 + [(None, None, None, None)] * 3 + [(8, None, "user", f"q{i}.") for i in range(200)]
    return rows


def test_repair_against_search(spark):
    """Hot, tied, repeated and null rows; one table of segments or one pass, the same report."""
    rows = made_up(1, 3000)
    want = plain(rows)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for segment in (7, 2048):
        report, repaired = repair.repair(table, segment=segment)
        assert {r[0]: tuple(r)[1:] for r in report.collect()} == want
        pieces = {}
        for r in repaired.orderBy("place").collect():
            pieces.setdefault(r["conv_id"], []).extend(r["turns"])
        for conv, turns in pieces.items():
            text = "\n".join(f"{t['role']}:{t['text']}" for t in turns)
            assert hashlib.sha256(text.encode()).hexdigest() == want[conv][-1]


def test_repair_by_hand():
    """Layers of a few turns; ties go to the ASCII-least audit."""
    for fault, best in ((repair.FINE, (0, "KKK")), (repair.CUT, (3, "RDK"))):
        layer = repair.begun(repair.START)
        for role, own in (("system", repair.FINE), ("user", fault), ("assistant", repair.FINE)):
            layer = repair.step(layer, role, own, 1)
        assert repair.ended(layer)[:2] == best
    one = repair.step(repair.begun(repair.START), "assistant", repair.FINE, 1)
    assert repair.ended(one)[:2] == (2, "D")
    assert repair.ended(repair.begun(repair.START)) == (0, "", repair.START)


def test_repair_nothing_left_and_extra_columns(spark):
    """A conversation that damage takes whole has zeros; clashing extra columns do nothing; an empty table gives no rows."""
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.", 1, "x")]
    table = spark.createDataFrame(rows, SCHEMA + ", copies int, fault string")
    report, repaired = repair.repair(table)
    assert [tuple(r) for r in report.collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert all(r["turns"] == [] for r in repaired.collect())
    assert repair.repair(table.limit(0))[0].count() == 0


def test_repair_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 2_000_000 + "."), (1, 1, "assistant", "a" * 5_000_000 + "!")]
    report = repair.repair(spark.createDataFrame(rows, SCHEMA))[0].collect()
    assert {r[0]: tuple(r)[1:] for r in report} == plain(rows)
