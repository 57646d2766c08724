import hashlib
import itertools
import re
import zlib

import pytest

from evidence.llm import turn_repair
from evidence.llm.queries import op12_turn_repair


def cheapest(turns):
    """turns: role, text, must go, truncated. The least (cost, audit) and its text, by every way through the turns."""
    states = {"": (0, "", ())}

    def better(found, key, item):
        if key not in found or item[:2] < found[key][:2]:
            found[key] = item

    def inserted(found):
        out = dict(found)
        for _ in range(2):
            for have, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    if allowed(have + role[0]):
                        better(out, shape(have + role[0]), (cost + 5, audit + "I", (*lines, f"{role}:")))
        return out

    # What came before matters only by whether it was empty, s alone, or its last role.
    allowed = lambda text: bool(re.fullmatch(r"s?(ua)*u?", text))
    shape = lambda text: text if text in ("", "s") else text[-1] if text[-1] != "a" else "ua"
    for role, text, must, open_ in turns:
        after = {}
        for have, (cost, audit, lines) in inserted(states).items():
            better(after, have, (cost + 2, audit + "D", lines))
            if must:
                continue
            extra = 5 if open_ else 0
            options = [("K", role[:1], role, 0)] if role else []
            for letter, initial, name, price in [*options, ("R", "u", "user", 1), ("R", "a", "assistant", 1)]:
                if initial in "sua" and allowed(have + initial):
                    better(after, shape(have + initial), (cost + price + extra, audit + letter, (*lines, f"{name}:{text}")))
        states = after
    cost, audit, lines = min(v for k, v in inserted(states).items() if k in ("", "ua"))
    return cost, audit, "\n".join(lines)


def expected(rows, tie=lambda role, text: (role, text)):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text, name = " " if role is None else role, " " if text is None else text, f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1], r[2])))
        seen, faults, turns = set(), [0, 0, 0], []
        for _, role, text in own:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                faults[fault] += 1
            turns.append((role, text, fault < 2, fault == 2))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, text = cheapest(turns)
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    got = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def read(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def test_conversations(spark, small):
    assert found(op12_turn_repair(spark, small)) == expected(read(spark, small))


def mixed(n, conv):
    roles = ["user", "assistant", "system", "user", "tool", "assistant", "", "umpire", None]
    texts = ["One.", "two", "Three!", " \n", "", "Four?\t", None, "five. six", "One."]
    return [(conv, t if t % 11 else None, roles[(t * 7 + conv) % 9 if t % 3 else t % 2], (texts[(t * 5 + conv * t) % 9] or "") + (str(t) + "." if t % 4 else "")) for t in range(n)]


@pytest.mark.parametrize("segment", [3, turn_repair.SEGMENT])
def test_odd_conversations(spark, monkeypatch, segment):
    """Nulls, odd roles, repeated rows, gaps, turns beyond a segment; a conversation cut in segments gives the same."""
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    rows = [r for c in range(40) for r in mixed(c, c) if r[1] is not None] + [(None, None, None, None), (None, 3, "user", "Hi."), (77, 5, "user", "x."), (77, 5, "user", "x."), (78, None, "system", "Only.")]
    rows += [(100, 3 * t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(60)] + [(101, t, "user", "Same.") for t in range(30)] + [(102, 4, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, times int, h string").repartition(6)
    assert found(turn_repair.turn_repair(df)) == expected(rows)
    assert turn_repair.turn_repair(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(5, t, ("system", "user", "assistant", "assistant")[t * t % 4], f"Turn {t % 400}" + ".!,"[t % 3]) for t in range(1500)] + mixed(9, 6)
    rows = [r for r in rows if r[1] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert found(turn_repair.turn_repair(df)) == expected(rows)


def test_everything_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 1, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert found(turn_repair.turn_repair(df)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
