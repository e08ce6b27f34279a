import hashlib
import heapq
import random
import re
import zlib

from soukline.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, there string, kind int, best int"
SPACES = " \t\n\x0b\x0c\r"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 0, 0) for r in rows], SCHEMA).repartition(parts)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub(r"[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_edits(turns):
    """Cheapest, then least edits by a search over whole edit strings: no dynamic program, no costs to go."""
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, roles, told = heapq.heappop(queue)
        if at == len(turns) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, told
        # the roles matter by their last letter, and by whether there are any
        if (at, roles[-1:]) in done:
            continue
        done.add((at, roles[-1:]))

        def go(cost, letter, at, role, text):
            now = roles + role[:1] if role else roles
            if role == "" or re.fullmatch(r"s?(ua)*u?", now) and role[:1]:
                more = ((role, text),) if letter != "D" else ()
                heapq.heappush(queue, (cost, audit + letter, at, now, told + more))

        for role in ("user", "assistant"):
            go(cost + 2, "I", at, role, "")
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, roles, told))
            tail = fault == "truncated"
            if fault not in ("blank", "duplicate"):
                if role:
                    go(cost + tail, "K", at + 1, role, text)
                for new in ("user", "assistant"):
                    go(cost + tail + 2, "R", at + 1, new, text)


def brute(rows):
    out = []
    whole = brute_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted(
            (r[1:] for r in whole if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
        )
        seen, turns, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            core = text.rstrip(SPACES)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
            if fault:
                count[fault] += 1
        numbers = [t for t, _, _ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        first = [r[:1] for r, _, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        cost, audit, told = brute_edits(turns)
        text = "\n".join(f"{r}:{t}" for r, t in told)
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, conversations=60, longest=9):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "System", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", "", " \n ", None, "Ünï. ", "a" * 50 + ".", "漢字"])
            at = rng.choice([turn, turn, turn, turn, turn + rng.randint(0, 3), None])
            rows.append((conv * 7, at, role, text + str(rng.randint(0, 3)) + "." if text == "Yes." else text))
    return rows


def test_query_equals_brute_force(spark):
    for seed, parts in ((1, 1), (2, 5)):
        rows = talk(seed)
        got = conversations.op13(frame(spark, rows, parts))
        assert got.columns == [x.split()[0] for x in conversations.DIGEST.split(", ")]
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_clean_conversations_are_left_alone(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"Line {t} of {c}.") for c in range(30) for t in range(4)]
    edits = conversations.repaired(frame(spark, rows).drop("there", "kind", "best")).collect()
    assert {r.edit for r in edits} == {"K"} and sum(r.cost or 0 for r in edits) == 0
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in edits) == sorted(rows)


def test_odd_rows(spark):
    long = "x" * 3_000_000 + "."
    rows = [
        (None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "b."), (1, None, "user", "b."), (2, 5, "user", long),
        (2, 6, "assistant", long), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "assistant", "a."), (4, -3, "system", "s."),
    ]
    rows += [(5, t, "user", "same.") for t in range(40)]
    got = conversations.op13(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert conversations.op13(frame(spark, [])).collect() == []


def test_a_conversation_of_which_all_rows_are_dropped_stays(spark):
    gone = next((c, t) for c in range(100) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = conversations.op13(frame(spark, [(*gone, "user", "a.")])).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_state_is_carried_over_batches_of_a_giant_conversation(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", "Why?"]) + str(t) + ".") for t in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = conversations.op13(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r) for r in got] == brute(rows)
