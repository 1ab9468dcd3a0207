"""Packing under three budgets against the loop that removes one message after the other."""

import random

import pytest

from tessera.operators import conversation
from tessera.operators import prompts as P


def tokens(text):
    return max(1, len(text) // 4)


def shown(role, text):
    line = text.lstrip()[:160].split("\n", 1)[0]
    return role == "user" and (line.startswith("Tool:") or line.startswith("Tool ") and "result:" in line)


def looped(rows, pinned, salience, whole, own, tool, base):
    """Rows of one conversation as (turn, role, text)."""
    rows = list(rows)
    cost = lambda r: 6 + tokens(r[1]) + tokens(r[2])
    part = lambda flag: [r for r in rows if shown(r[1], r[2]) == flag]
    size = lambda some: 12 + sum(map(cost, some)) if some else 0
    worth = lambda r: (salience.get(r[0], 0.0), r[0])

    def drop(some):
        free = [r for r in some if r[0] not in pinned]
        if free:
            rows.remove(min(free, key=worth))
        return bool(free)

    while size(part(True)) > tool and drop(part(True)):
        pass
    while size(part(False)) > own and drop(part(False)):
        pass
    while base + sum(map(cost, rows)) > whole and drop(rows):
        pass
    return {r[0]: r[2] for r in rows}


@pytest.mark.parametrize(("limit", "history", "results", "system"), [(1400, 300, 150, 40), (900, 12000, 1400, 0), (3000, 200, 900, 300), (200, 100, 100, 0), (100_000, 12000, 1400, 10)])
def test_packing_equals_the_loop(spark, limit, history, results, system):
    r = random.Random(limit)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(2, 9)))
    said = lambda n: " ".join(word() + ("." if r.random() < 0.2 else "") for _ in range(n))
    rows = []
    for conv in range(12):
        for turn in range(r.randrange(1, 14)):
            role = r.choice(["user", "user", "assistant"])
            head = r.choice(["", "", "Tool vector_search result: x\nshared\n"]) if role == "user" else ""
            rows.append((conv, turn, role, head + said(r.randrange(0, 160)), role == "assistant" and r.random() < 0.5))
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, has_calls boolean").cache()
    salience = conversation.salience(frame)
    got = P.pack(frame, salience, limit, 200, system, 1, slack=64, history=history, results=results).collect()
    whole, own, tool = P.budgets(limit, 200, system, 64, history, results)
    ready = P.staged(frame, salience)
    held = {(x.conv_id, x.turn) for x in P.pinned(ready, 1).where("pinned").collect()}
    worth = {(x.conv_id, x.turn): x.salience for x in salience.collect()}
    cut = ready.select("conv_id", "turn", "role", "text").collect() if whole else frame.collect()
    dropped = 0
    for conv in range(12):
        mine = sorted((x.turn, x.role, x.text) for x in cut if x.conv_id == conv)
        turns = {t for t, _, _ in mine}
        want = looped(mine, {t for t in turns if (conv, t) in held}, {t: worth[conv, t] for t in turns if (conv, t) in worth}, whole, own, tool, 12 + system) if whole else {t: x for t, _, x in mine}
        assert {x.turn: x.text for x in got if x.conv_id == conv} == want
        assert {x.after_tokens for x in got if x.conv_id == conv} == {12 + system + sum(6 + tokens(role) + tokens(want[t]) for t, role, _ in mine if t in want)}
        dropped += len(mine) - len(want)
    assert (dropped > 0) == (0 < whole < 5000)


def test_budgets():
    assert P.budgets(0, 100, 0)[0] == 0 and P.budgets(500, 400, 0)[0] == 0
    whole, own, tool = P.budgets(20_000, 1000, 100)
    assert whole == 20_000 - 1000 - 300 - 150 - 384 and own + tool <= whole - 112 and own / tool == pytest.approx(12_000 / 1_400, rel=0.01)
    assert P.budgets(900, 100, 400)[1:] == (256, 128)
