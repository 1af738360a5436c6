import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from blockmill.llm import dialogues, queries
from tests.helpers import DATA

SHAPE = re.compile("(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows, faults):
    """(cost, audit, repaired) by trying all lists of edits, with up to two inserts at each place."""
    best = None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]

    def extend(i, cost, letters, made):
        nonlocal best
        for added in inserts:
            put = [(role, "") for role in added]
            if i == len(rows):
                total, audit, out = cost + 5 * len(added), letters + "I" * len(added), made + put
                if SHAPE.fullmatch("".join(r[:1] for r, _ in out)):
                    best = min([best, (total, audit, out)] if best else [(total, audit, out)], key=lambda b: b[:2])
                continue
            here, so_far = cost + 5 * len(added), letters + "I" * len(added)
            if best and here > best[0]:
                continue
            role, text = rows[i]
            extend(i + 1, here + 2, so_far + "D", made + put)
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                extend(i + 1, here + extra, so_far + "K", [*made, *put, (role, text)])
                for other in ("user", "assistant"):
                    extend(i + 1, here + 1 + extra, so_far + "R", [*made, *put, (other, text)])

    extend(0, 0, "", [])
    return best


def programme(rows, faults):
    """(cost, audit, repaired) by a table of whole lists of edits per prefix of the shape."""
    def state(letters):
        return "start" if not letters else "s" if letters == "s" else letters[-1]

    def moves(out, added):
        letters = "".join(r[:1] for r, _ in out + added)
        return re.fullmatch("s?(ua)*u?", letters) is not None

    table = {"start": (0, "", [])}

    def relax(entries):
        new = {}
        for cost, audit, out in entries:
            for added in ([], [("user", "")], [("assistant", "")], [("user", ""), ("assistant", "")],
                          [("assistant", ""), ("user", "")]):
                if moves(out, added):
                    entry = (cost + 5 * len(added), audit + "I" * len(added), out + added)
                    key = state("".join(r[:1] for r, _ in entry[2]))
                    new.setdefault(key, []).append(entry)
        return {k: v for k, v in new.items()}

    # All cheapest lists are kept per state: which of them comes first is known at the end.
    kept = {k: v for k, v in relax([table["start"]]).items()}
    for (role, text), fault in zip(rows, faults):
        entries = []
        for cost, audit, out in itertools.chain(*kept.values()):
            entries.append((cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if moves(out, [(role, text)]):
                    entries.append((cost + extra, audit + "K", [*out, (role, text)]))
                for other in ("user", "assistant"):
                    if moves(out, [(other, text)]):
                        entries.append((cost + 1 + extra, audit + "R", [*out, (other, text)]))
        grouped = relax(entries)
        kept = {}
        for key, found in grouped.items():
            low = min(e[0] for e in found)
            kept[key] = list({e[1]: e for e in found if e[0] == low}.values())
    ends = [e for k in ("start", "a") for e in kept.get(k, [])]
    return min(ends, key=lambda e: e[:2])


def brute(rows, solve=programme):
    """The audit of (turn, role, text) rows as they are."""
    rows = sorted(
        ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]),
    )
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = (
            "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        )
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    letters = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    cost, audit, out = solve([(r, x) for _, r, x in rows], faults)
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), out


def damage(rows):
    """{conv: [(turn, role, text)]} after the damage of the query."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def made_up(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No", "", None, "Well! ", "Hm?\n", "\t", f"{rng.random()}.", "é."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 2**60 + turn]), role, text))
    return rows


def by_conversation(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_two_plain_versions_agree():
    rng = random.Random(2)
    for _ in range(60):
        rows = by_conversation(made_up(rng, 1, 4))
        for mine in rows.values():
            assert brute(mine) == brute(mine, cheapest)


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_audits_and_repairs_equal_brute_force(spark, batch):
    rows = made_up(random.Random(3), 150, 9) + [(None, 1, "user", "Hi."), (None, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit(1), "fault": F.lit("x")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        audits = {r.conv_id: tuple(r)[1:] for r in dialogues.audit_conversations(df).collect()}
        repaired = dialogues.repair_conversations(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {conv: brute(mine) for conv, mine in by_conversation(rows).items()}
    assert audits == {conv: audit for conv, (audit, _) in want.items()}
    got = {}
    for r in sorted(repaired, key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {conv: out for conv, (_, out) in want.items() if out}


def test_damaged_rows(spark):
    rows = made_up(random.Random(4), 300, 6) + [(10**15 + 1, None, None, None), (None, None, "user", "a.")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in dialogues.audit_damaged(df).collect()}
    assert got == {conv: brute(mine)[0] for conv, mine in damage(rows).items()}
    assert any(not mine for mine in damage(rows).values())


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_dialogues(spark, DATA).collect()}
    assert got == {conv: brute(mine)[0] for conv, mine in damage(rows).items()}


def test_giant_conversation_and_empty_table(spark):
    df = spark.range(200_000).select(
        F.lit("c").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("m"), F.col("id"), F.when(F.col("id") % 1000 == 999, "").otherwise(".")).alias("text"),
    )
    row = dialogues.audit_conversations(df).first()
    # Each cut message is deleted; in its place the user's before it goes, or an insert would cost more.
    assert (row.gaps, row.truncated, row.illegal, row.cost) == (0, 200, 0, 800)
    assert row.audit == ("K" * 998 + "DD") * 200
    assert dialogues.audit_conversations(df.limit(0)).count() == 0
    assert dialogues.repair_conversations(df.limit(0)).count() == 0
