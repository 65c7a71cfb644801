"""Conversation repair against plain search over all edits, and a plain version of the whole report."""
import hashlib
import random
import re
import zlib

from dawnscore.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, seq string, part string"


def faults(rows):
    """blank, again, unfinished per row, by its first fault."""
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)
        kind = "blank" if not last else "again" if (role, text) in seen else "open" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def search(rows):
    """Every sequence of edits within the cost of deleting all, by recursion: (cost, audit, repaired lines)."""
    kinds = faults(rows)
    best = [(4 * len(rows), "D" * len(rows), [])]

    def sound(roles):
        return re.fullmatch("(s?(ua)+)?", roles)

    def prefix(roles):
        return re.fullmatch("s?(ua)*u?", roles)

    def go(at, roles, lines, cost, audit):
        if cost > best[0][0] or not prefix(roles):
            return
        if at == len(rows) and sound(roles):
            best[0] = min(best[0], (cost, audit, lines))
        for role in ("user", "assistant"):
            go(at, roles + role[0], [*lines, f"{role}:"], cost + 3, audit + "I")
        if at == len(rows):
            return
        _, role, text = rows[at]
        go(at + 1, roles, lines, cost + 4, audit + "D")
        if kinds[at] not in ("blank", "again"):
            more = 3 * (kinds[at] == "open")
            go(at + 1, roles + (role[:1] or "-"), [*lines, f"{role}:{text}"], cost + more, audit + "K")
            for new in ("user", "assistant"):
                go(at + 1, roles + new[0], [*lines, f"{new}:{text}"], cost + more + 3, audit + "R")
    go(0, "", [], 0, "")
    return best[0]


def report(rows):
    """rows: (conv, turn, role, text) -> conv -> the contract's columns."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fault = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            role = "user" if fault == 4 else role
            after += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        kinds, turns = faults(after), [r[0] for r in after if r[0] is not None]
        cost, audit, lines = search(after)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "again", "open")), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "so", " ", None, "Why?\n", f"t{turn}.", f"t{turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def test_report_equals_search_over_all_edits(spark):
    rows = random_rows(3, 150, 6) + [(None, 0, "user", "Who?"), (None, None, None, None)]
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_report(frame(spark, rows)).collect()}
    assert got == report(rows)
    assert {"K", "R", "D", "I"} <= set("".join(v[6] for v in got.values()))


def test_empty_table_and_conversations_that_are_gone(spark):
    assert cr.repair_report(frame(spark, [])).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = cr.repair_report(frame(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def left_to_right(kinds):
    """Cheapest (cost, audit) by a walk over turns and states, for conversations of any length."""
    cells = {q: v for q, v in cr.inserted()[0].items()}
    for kind in kinds:
        cells = cr.joined([cells], cr.terminal(*kind))[0]
    return min(cells[q] for q in cr.GOALS if q in cells)


def test_every_split_of_a_span_gives_the_same_cell():
    rng = random.Random(5)
    for _ in range(60):
        spans = [cr.terminal(rng.choice("suax"), rng.random() < .3, rng.random() < .2) for _ in range(7)]
        table = {(k, k + 1): spans[k] for k in range(7)}
        for size in range(2, 8):
            for i in range(8 - size):
                cells = [cr.joined(table[i, k], table[k, i + size]) for k in range(i + 1, i + size)]
                assert all(c == cells[0] for c in cells)
                table[i, i + size] = cells[0]
        assert table[0, 7] == cr.combined(spans)


def test_long_conversation_runs_through_many_tasks(spark):
    rng = random.Random(11)
    roles = [rng.choice(["user", "assistant", "assistant", "user", "system"]) for _ in range(12_000)]
    rows = [(7, k, role, f"{k}" + rng.choice([".", "!", "", "."])) for k, role in enumerate(roles)]
    rows += [(8, 0, "user", "A?"), (8, 1, "assistant", "B."), (7, 12_000, "user", "3."), (7, 12_001, roles[3], rows[3][3])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = frame(spark, rows)
        got = {r.conv_id: r for r in cr.verdicts(turns).collect()}
        found = sorted(cr.repaired(turns, cr.verdicts(turns)).filter("conv_id = 7").collect(), key=lambda r: r.place)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mine = [r[1:] for r in rows if r[0] == 7]
    kinds = faults(mine)
    want = left_to_right([(role[0], kind == "open", kind in ("blank", "again")) for (_, role, _), kind in zip(mine, kinds)])
    r = got[7]
    assert (r.cost, r.audit) == want
    assert (r.gaps, r.duplicate, r.truncated) == (0, kinds.count("again"), kinds.count("open"))
    assert r.illegal == sum(a[1][0] + b[1][0] not in cr.LEGAL for a, b in zip(mine, mine[1:]))
    assert (got[8].cost, got[8].audit) == (0, "KK")
    assert [x.place for x in found] == list(range(len(found)))
    assert re.fullmatch("s?(ua)+", "".join(x.role[0] for x in found))
    assert "".join(x.edit for x in found) == r.audit.replace("D", "")
