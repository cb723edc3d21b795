"""Repairs against a plain dynamic programme over whole conversations, and the search against all edit sequences."""

import hashlib
import random
import zlib

import pytest

from scorelens.llm import queries, repair

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\v\f\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, first string, place int, there boolean, audit int"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = {1: "", 2: text.replace(".", "").replace("!", "").replace("?", "")}.get(kind, text)
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def best_edits(rows):
    """Least (cost, audit, lines) by a table over (rows read, last role) that keeps whole audits."""
    start, roles = "", {"u": "user", "a": "assistant"}
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    table = {start: (0, "", ())}

    def inserted(table):
        for _ in range(3):
            for last, (cost, audit, lines) in list(table.items()):
                for to in follows[last].replace("s", ""):
                    new = (cost + 2, audit + "I", (*lines, (roles[to], "")))
                    table[to] = min(table.get(to, new), new)
        return table

    for role, text, fault in rows:
        after = {}
        for last, (cost, audit, lines) in inserted(table).items():
            steps = [(last, 3, "D", lines)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] and role[0] in follows[last]:
                    steps.append((role[0], extra, "K", (*lines, (role, text))))
                steps += [(to, 2 + extra, "R", (*lines, (roles[to], text))) for to in follows[last].replace("s", "")]
            for to, more, edit, new_lines in steps:
                new = (cost + more, audit + edit, new_lines)
                after[to] = min(after.get(to, new), new)
        table = after
    return min(v for k, v in inserted(table).items() if k in ("", "a"))


def plain(rows):
    out = []
    for conv, kept in damaged(rows).items():
        kept = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}:{r[2]}".encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.rstrip(BLANKS)
            faults.append(
                "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            )
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        cost, audit, lines = best_edits([(role, text, f) for (_, role, text), f in zip(kept, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows, parts=3):
    """Rows with further columns under names that the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1, False, 2) for r in rows], SCHEMA).repartition(parts)


def noisy(count, seed, convs, turns=8):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? ", None, "Ünder.\n", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]
    return [
        (rng.choice(convs), rng.choice([None, *range(turns)]), rng.choice(roles), rng.choice(texts)) for _ in range(count)
    ]


def ask(spark, rows, parts=3):
    return result(repair.repair(repair.damaged(table(spark, rows, parts)), marked=True))


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_repair(spark, SF)) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_odd_rows(spark, seed):
    rows = noisy(400, seed, [None, *range(60)])
    assert ask(spark, rows) == plain(rows)


def test_long_conversations_over_many_partitions(spark):
    rows = noisy(700, "long", [5], 300) + noisy(60, "short", [4, 6, 7])
    rows += [(5, 1000 + i, "user" if i % 2 else "assistant", f"Turn {i}.") for i in range(400)]
    assert ask(spark, rows, 8) == plain(rows)


def test_empty_table(spark):
    assert ask(spark, []) == []


def test_conversation_without_rows_after_damage(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert ask(spark, [(conv, 0, "user", "Gone.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_read_well(spark):
    rows = [r for r in noisy(300, "turns", [None, *range(40)]) if r[2] != ""]
    frame = table(spark, rows)
    found = repair.repair(frame)
    turns = {}
    for r in sorted(repair.repaired_turns(frame, found).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(r)
    for r in found.collect():
        lines = turns.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in lines).encode()).hexdigest() == r.repaired_sha256
        initials = "".join(t.role[0] for t in lines).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2) and (initials or not lines)


def test_search_equals_all_edit_sequences():
    rng = random.Random(7)
    kinds = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    for _ in range(300):
        rows = [(rng.choice("suat "), rng.choice(list(kinds))) for _ in range(rng.randint(0, 7))]
        expected = best_edits([(role, "", fault) for role, fault in rows])
        found = repair.cheapest([(role, kinds[fault]) for role, fault in rows], repair.START, repair.FINAL)
        assert found == expected[:2]


def test_long_search_is_quick():
    rng = random.Random(8)
    rows = [(rng.choice("suat"), rng.randint(0, 3)) for _ in range(20_000)]
    cost, audit = repair.cheapest(rows, repair.START, repair.FINAL)
    assert len(audit.replace("I", "")) == len(rows) and cost > 0
