"""Conversation repair against a plain programme over all edit strings."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import product

import pytest
from helpers import prose

from cohortline.llm import turn_repair as turns

SCHEMA = "conv_id long, turn long, role string, text string, _key long, _row long, place long, n string"
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_edits(rows):
    """(cost, least string, repaired rows) of (role, text, fault) rows; the last written role stands for the state."""
    after = {}
    for state in ("a", ""):
        after[state] = (0, "", ())
    for state, missing in (("u", 1), ("s", 2)):
        names = [("assistant", "")] if state == "u" else [("user", ""), ("assistant", "")]
        after[state] = (5 * missing, "I" * missing, tuple(names))
    for role, text, fault in reversed(rows):
        here = {}
        for state in ("", "s", "u", "a"):
            want = "assistant" if state == "u" else "user"
            options = [(2 + after[state][0], "D" + after[state][1], after[state][2])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                to = STEP[state].get(role[:1])
                if to is not None:
                    options.append((more + after[to][0], "K" + after[to][1], ((role, text), *after[to][2])))
                to = want[0]
                options.append((1 + more + after[to][0], "R" + after[to][1], ((want, text), *after[to][2])))
            here[state] = min(options, key=lambda x: x[:2])
        for _ in range(4):
            for state in ("", "s", "u", "a"):
                want = "assistant" if state == "u" else "user"
                inserted = (5 + here[want[0]][0], "I" + here[want[0]][1], ((want, ""), *here[want[0]][2]))
                here[state] = min(here[state], inserted, key=lambda x: x[:2])
        after = here
    return after[""]


def plain_report(rows, damaged=True):
    """The report of each conversation of (conv_id, turn, role, text) rows."""
    kept = {}
    for conv, turn, role, text in rows:
        out = kept.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out += [(turn, role, text)] * (2 if case == 3 else 1)
    reports = []
    for conv, out in kept.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, faults = set(), [], Counter()
        for _, role, text in out:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault))
        numbers = {t for t, *_ in out if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
        cost, audit, repaired = plain_edits(marked)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in repaired))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        reports.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return reports


def awkward():
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 4, "user", "no end"), (1, 4, "user", "no end"), (1, 9, "assistant", "\t\n ")]
    rows += [(2, None, "user", None), (2, None, None, "x."), (2, 3, "", "y!"), (2, 3, "tool", "z?"), (None, 1, "user", "a."), (None, None, None, None)]
    rows += [(3, None, "assistant", "b."), (4, -3, "user", "é. \x0b"), (4, 5, "assistant", "ß ")]
    for i in range(300):
        n = i % 7
        role = ("user", "assistant", "user", "assistant", "system", "tool", "user")
        rows += [(100 + i, k, role[(k * (1 + i % 3) + i // 50) % 7], prose(i * 9 + k, 1 + k) + (".", "", "!", "?")[(i + k) % 4]) for k in range(n + 1)]
    rows += [(7, k, ("user", "assistant")[k % 2], f"{k % 40}.") for k in range(180)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, 7, "x") for r in rows], SCHEMA).repartition(5)


def test_edits_equal_the_plain_programme():
    faults = {0: None, 4: "truncated", 8: "blank"}
    kinds = [(r, f) for f in (0, 4, 8) for r in ("s", "u", "a", "t")]
    for n in range(4):
        for rows in product(kinds, repeat=n):
            codes = [turns.kind(r, f == 4, f == 8) for r, f in rows]
            cost, audit, _ = plain_edits([(r, "", faults[f]) for r, f in rows])
            edits, state = turns.walk(codes)
            assert ("".join(edits), turns.costs(codes)[0]) == (audit, cost) and state in (0, 3)


def test_segments_chain():
    codes = [(i * i + i // 3) % 12 for i in range(200)]
    whole = turns.walk(codes)[0]
    for cut in (1, 7, 100, 199):
        middle = turns.costs(codes[cut:])
        matrix = turns.transfer(codes[:cut])
        assert turns.costs(codes) == tuple(min(m + v for m, v in zip(line, middle)) for line in matrix)
        first, state = turns.walk(codes[:cut], 0, middle, last=False)
        assert first + turns.walk(codes[cut:], state)[0] == whole


@pytest.mark.parametrize("hot", [10**6, 20, 2])
def test_reports(spark, monkeypatch, hot):
    """Conversations whole in a task, some cut into segments, and nearly all cut."""
    monkeypatch.setattr(turns, "HOT_TURNS", hot)
    monkeypatch.setattr(turns, "SEGMENT", 30)
    rows = awkward()
    got = Counter(tuple(r) for r in turns.repair_damaged(frame(spark, rows)).collect())
    assert got == Counter(plain_report(rows))
    got = Counter(tuple(r) for r in turns.repair(frame(spark, rows)).collect())
    assert got == Counter(plain_report(rows, damaged=False))
    lines = {}
    for r in sorted(turns.repair(frame(spark, rows), report=False).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    empty = hashlib.sha256(b"").hexdigest()
    for conv, *_, digest in plain_report(rows, damaged=False):
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == digest or (conv not in lines and digest == empty)


def test_no_conversations(spark):
    assert turns.repair_damaged(frame(spark, [])).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = turns.repair_damaged(frame(spark, [(dropped, 0, "user", "a.")])).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
