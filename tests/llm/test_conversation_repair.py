import hashlib
import itertools
import random
import zlib

import pytest

from candlewick.llm import conversation_repair as cr
from candlewick.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, p_kind string"
SOLID = "\x20\x09\x0a\x0b\x0c\x0d"


def after_damage(rows):
    found = {}
    for conv, turn, role, text, *_ in rows:
        place = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        n = zlib.crc32(key.encode()) % 20
        if n == 0:
            continue
        text = "" if n == 1 else "".join(c for c in text if c not in ".!?") if n == 2 else text
        place += [(turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: sorted(place, key=order) for conv, place in found.items()}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        solid = text.strip(SOLID)
        found.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    return found


def least(rows, marks):
    """Cost, audit and messages by a forward search that keeps every text, in pairs (cost, audit)."""
    best = {"": (0, "", ())}  # by the roles' last initial
    ok = {"": "su", "s": "u", "u": "a", "a": "u"}

    paths = {k: [v] for k, v in best.items()}
    for (_, role, text), mark in zip(rows, marks):
        step = {}
        for last, options in paths.items():
            for cost, audit, out in options:
                starts = [(last, cost, audit, out)]
                for new in ("user", "assistant"):
                    if new[0] in ok[last]:
                        starts.append((new[0], cost + 5, audit + "I", (*out, (new, ""))))
                for at, c, a, o in starts:
                    step.setdefault(at, []).append((c + 2, a + "D", o))
                    if mark in "bd" and mark:
                        continue
                    more = 5 if mark else 0
                    if role[:1] and role[0] in ok[at]:
                        step.setdefault(role[0], []).append((c + more, a + "K", (*o, (role, text))))
                    for new in ("user", "assistant"):
                        if new[0] in ok[at]:
                            step.setdefault(new[0], []).append((c + 1 + more, a + "R", (*o, (new, text))))
        paths = {k: sorted(set(v))[:400] for k, v in step.items()}
    done = []
    for last, options in paths.items():
        for cost, audit, out in options:
            if last in ("", "a"):
                done.append((cost, audit, out))
            elif last == "u":
                done.append((cost + 5, audit + "I", (*out, ("assistant", ""))))
            else:
                done.append((cost + 10, audit + "II", (*out, ("user", ""), ("assistant", ""))))
    return min(done)


def brute(rows):
    found = []
    for conv, place in after_damage(rows).items():
        marks = faults(place)
        cost, audit, out = least(place, marks)
        turns = [t for t, _, _ in place if t is not None]
        initials = [r[:1] for _, r, _ in place]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in out)
        found.append((conv, gaps, *(marks.count(m) for m in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=str)


def talks(seed, n, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "users"]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "a\tb!", "Well...  ", "x" * 300 + ".", "x" * 300 + "y.", "é!", "日本 "]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            turn = rng.choice([turn, turn, turn, turn, turn + 1, None])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts), "x"))
    rows += rows[::9]  # repeated rows
    return [*rows, (None, 1, "user", "Hm.", ""), (None, None, None, None, None)]


def got(spark, rows):
    found = cr.repair(cr.damaged(spark.createDataFrame(rows, SCHEMA)))
    return sorted(map(tuple, found.collect()), key=str)


def test_short_conversations_against_brute_force(spark):
    rows = talks(1, 120)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("piece", [1, 3])
def test_pieces_against_brute_force(spark, monkeypatch, piece):
    """A conversation that holds most rows, cut into pieces and over partitions."""
    rng = random.Random(piece)
    rows = talks(2, 12)
    rows += [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B!", "C", f"{t}.", f"{t}"]), "") for t in range(150)]
    cut = cr._first

    def cut_small(schema, build):
        def run(batches):
            cr.PIECE = piece  # in the worker
            yield from cut(schema, build)(batches)

        return run

    monkeypatch.setattr(cr, "_first", cut_small)
    assert got(spark, rows) == brute(rows)


def test_products_do_not_depend_on_the_cuts():
    rng = random.Random(4)
    for _ in range(200):
        rows = [cr.Row(i, rng.choice(["user", "assistant", "system", "tool"]), "x.", rng.choice(["", "", "b", "t"])) for i in range(rng.randint(1, 9))]
        width = 2 * len(rows) + 2
        whole = cr.passed(rows, cr.endings(width), width)[0]
        cuts = sorted(rng.sample(range(len(rows) + 1), min(3, len(rows))))
        pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        end = cr.Node(2, [[None if e != f else v for f, v in enumerate(cr.endings(2))] for e in cr.STATES])
        node = cr.composed([*map(cr.matrix, pieces), end])
        best, f = min((v, f) for f, v in enumerate(node.weights[0]) if v is not None)
        assert (whole >> 3 * width, cr.letters(whole, width)) == (best >> 3 * node.width, cr.letters(best, node.width))
        assert "".join(cr.audits(node, 0, f)) == cr.letters(best, node.width)


def test_every_short_list_of_roles():
    """All lists of up to four rows against a search over all edits."""
    kinds = [("user", ""), ("assistant", ""), ("system", ""), ("user", "t"), ("tool", ""), ("assistant", "b")]
    for n in range(5):
        for combination in itertools.product(kinds, repeat=n):
            rows = [cr.Row(i, role, f"{i}", mark) for i, (role, mark) in enumerate(combination)]
            width = 2 * n + 2
            weight = cr.passed(rows, cr.endings(width), width)[0]
            cost, audit, out = least([(r.turn, r.role, r.text) for r in rows], [r.fault for r in rows])
            assert (weight >> 3 * width, cr.letters(weight, width)) == (cost, audit)
            assert tuple(cr.repaired(rows, audit)) == out


def test_long_texts_and_many_copies(spark):
    rows = [(1, 3, "user", "long " * 200_000 + "end.", ""), (1, 4, "assistant", "z" * 1_500_000, "")]
    rows += [(2, 7, "user", "again.", "")] * 3000 + [(2, 9, "assistant", "Right.", "")]
    assert got(spark, rows) == brute(rows)


def test_messages(spark):
    rows = [(1, i, r, t, "") for i, (r, t) in enumerate([("system", "Be."), ("assistant", "Hi."), ("user", "Yes."), ("user", "No")])]
    df = spark.createDataFrame(rows, SCHEMA)
    found = cr.repair(cr.prepared(df), messages=True).orderBy("place").collect()
    assert [tuple(r) for r in found] == [(1, 0, "system", "Be."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes.")]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_query(spark, tmp_path):
    rows = talks(6, 40)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    kinds = dict(found.dtypes)
    assert kinds.pop("audit") == kinds.pop("repaired_sha256") == "string" and set(kinds.values()) == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
