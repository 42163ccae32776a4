"""Repair of conversations against a plain search over whole strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import queries, repair

SPACE = " \t\n\x0b\f\r"


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """Cost, audit and letters for rows of (initial, fault: f fine, t truncated, else to be deleted), by the best string of each state after each row."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def put(table, state, way):
        if state not in table or way < table[state]:
            table[state] = way

    def inserted(table):
        for _ in range(4):
            for q, (cost, audit, letters) in list(table.items()):
                put(table, after[q], (cost + 2, audit + "I", letters + after[q]))
        return table

    table = {"": (0, "", "")}
    for initial, fault in rows:
        made = {}
        for q, (cost, audit, letters) in inserted(table).items():
            put(made, q, (cost + 3, audit + "D", letters + "D"))
            if fault in "ft":
                more = fault == "t"
                if initial == after[q] or (initial, q) == ("s", ""):
                    put(made, initial, (cost + more, audit + "K", letters + "K"))
                put(made, after[q], (cost + 2 + more, audit + "R", letters + after[q].upper()))
        table = made
    table = inserted(table)
    return min(table[q] for q in ("", "a") if q in table)


def test_edits_equal_a_search_over_strings():
    rng = random.Random(5)
    for _ in range(1500):
        rows, n = [], rng.choice([1, 2, 5, 8, 13, 40])
        while len(rows) < n:
            rows += [(rng.choice("suaax"[: rng.choice([3, 4, 5])]), rng.choice("fffftbd"))] * rng.choice([1, 1, 1, 2, 5, 17])
        symbols = np.array(["suax".index(i) * repair.FAULTS + "ftbd".index(f) for i, f in rows], np.uint8)
        letters, state, cost = repair.edits(symbols)
        letters += repair.closing(state)
        assert (cost, letters.translate(str.maketrans("uaUA", "IIRR")), letters) == cheapest(rows)


def test_long_runs_take_few_steps():
    n = 100_003
    repair._remembered.cache_clear()
    letters, _, cost = repair.edits(np.full(n, 1 * repair.FAULTS, np.uint8))
    assert letters == "Ka" + "KA" * (n // 2) and cost == n + 1 and repair._remembered.cache_info().misses < 1000


def expected(rows):
    """conv_id to the columns of op11, from rows as they are after damage."""
    every = {}
    for conv, turn, role, text in rows:
        every.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv, own in every.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, marked = set(), []
        for _, role, text in own:
            end = text.rstrip(SPACE)[-1:]
            marked.append((role[:1], "b" if not end else "d" if (role, text) in seen else "f" if end in ".!?" else "t"))
            seen.add((role, text))
        cost, audit, letters = cheapest(marked)
        lines, i = [], 0
        for c in letters:
            if c in "ua":
                lines.append({"u": "user:", "a": "assistant:"}[c])
                continue
            if c != "D":
                lines.append({"K": own[i][1], "U": "user", "A": "assistant"}[c] + ":" + own[i][2])
            i += 1
        turns = {t for t, _, _ in own if t is not None}
        faults = [f for _, f in marked]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of_all_kinds():
    rng = random.Random(3)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 2, 3, 7, 8, 30])):
            text = rng.choice(["Hello.", "Right?", "cut of", "", " \t", "é!", "one\ntwo.", "Hello.", f"text {turn}.", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), text))
    rows += [(100, t, "user", "Again.") for t in range(50)] + [(101, 5, "user", "x" * 300_000 + ".")]
    return rows


@pytest.mark.parametrize("chunk", [1 << 16, 3])
def test_repair_of_nulls_ties_and_long_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = rows_of_all_kinds()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).select("*", *[F.lit(1).alias(c) for c in ("row", "edit", "chunk", "place", "digest")])
    made = repair.repair(df)
    told = repair.with_conversation(made.counts, repair.digests(repair.repaired(made.turns)))
    got = {r[0]: (*r[1:8], r.repaired_sha256 or hashlib.sha256().hexdigest()) for r in told.collect()}
    assert got == expected(rows)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    made = repair.repair(df)
    assert made.counts.count() == 0 and repair.digests(repair.repaired(made.turns)).count() == 0


def test_far_turns(spark):
    df = spark.createDataFrame([("a", -(2**63), "user", "x."), ("a", 2**63 - 1, "assistant", "y.")], "conv_id string, turn long, role string, text string")
    (row,) = repair.repair(df).counts.collect()
    assert row.gaps is None and row.audit == "KK"


def test_query_keeps_conversations_that_damage_empties(spark, tmp_path):
    import zlib

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for c in range(200) for t in range(1)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op11_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    gone = {c for c, t, _, _ in rows if c is not None and zlib.crc32(f"{c}:{t}".encode()) % 20 == 0}
    assert gone and all(tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in gone)
