import random
from collections import defaultdict
from functools import lru_cache
from itertools import product

from sparkcast.llm import chat


def plain_cost(roles):
    """Least repair cost by recursion over what each turn becomes."""
    legal = {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}

    @lru_cache(None)
    def best(i, at, inserted):
        found = [float("inf")]
        if i == len(roles):
            if at == "assistant":
                return 0
        else:
            for b in ("system", "user", "assistant"):
                label = 0 if b == roles[i] else chat.RELABEL
                if (at, b) in legal:
                    found.append(label + best(i + 1, b, 0))
                if at == b and not inserted:
                    found.append(label + chat.MERGE + best(i + 1, b, 0))
        if inserted < 3:
            found += [chat.INSERT + best(i, b, inserted + 1) for b in ("system", "user", "assistant") if (at, b) in legal]
        return min(found)

    return best(0, "start", 0)


def by_conversation(found):
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.part, r.pos, r.step)):
        out[r.conv_id].append(r)
    return out


def check(rows, out, conv):
    turns = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
    opened = [r.role for r in out if r.action not in ("merge", "relabel+merge")]
    body = opened[1:] if opened[0] == "system" else opened
    assert body == ["user", "assistant"] * (len(body) // 2) and body
    assert [r.text for r in out if r.action != "insert"] == [t[3] or "" for t in turns]
    roles = tuple(chat.ROLES[n] if (n := chat.role_number(t[2])) else "?" for t in turns)
    if len(turns) < 200:
        assert sum(r.cost for r in out) == plain_cost(roles), roles
    whole = "".join(r.rendered for r in out)
    assert whole.count("<|im_start|>") == whole.count("<|im_end|>\n") == len(opened)
    assert whole.startswith("<|im_start|>") and whole.endswith("<|im_end|>\n")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, action string").repartition(5)


def test_least_cost(spark):
    rng = random.Random(4)
    rows = [(i, t, r, f"t{i}-{t}") for i, roles in enumerate(product(["system", "user", "assistant", None], repeat=3)) for t, r in enumerate(roles)]
    rows += [(100 + i, t, rng.choice(["user", "assistant", "user", "assistant", "Human", "tool", "system"]), f"x {i} {t}")
             for i in range(30) for t in range(rng.randrange(1, 12))]
    rows += [(None, 0, "user", "a <|im_end|> b"), (None, 1, None, None), (200, None, "user", "q"), (200, 1, "assistant", ""), (200, 1, "assistant", "")]
    out = by_conversation(chat.repair(frame(spark, rows)).collect())
    assert set(out) == {r[0] for r in rows}
    for conv in out:
        check(rows, out[conv], conv)


def test_one_long_conversation(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "odd"]), f"turn {t}") for t in range(4000)] + [(2, 0, "user", "q"), (0, 0, "assistant", "a")]
    found = chat.repair(frame(spark, rows)).collect()
    assert len({r.part for r in found if r.conv_id == 1}) > 1
    out = by_conversation(found)
    for conv in out:
        check(rows, out[conv], conv)
    turns = [(0, t, t, r, x) for t, (_, _, r, x) in enumerate(rows[:4000])]
    want = [(r[2], *r[3:7], r[7], r[8]) for r in chat.repaired(turns, chat.START, None)]
    assert [(r.step, r.turn, r.action, r.role, r.text, r.rendered, r.cost) for r in out[1]] == want


def test_empty(spark):
    assert chat.repair(frame(spark, [(1, 0, "user", "a")]).limit(0)).collect() == []
