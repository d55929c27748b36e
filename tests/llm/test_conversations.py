"""The prefix trie and the repair of conversations against plain Python versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import prefix_trie as trie
from millrace.llm import repair as mend
from millrace.llm.places import numbered

# Columns beyond the table's own bear names that the operators use inside.
SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, pos INT, node STRING, part INT, conv STRING, d1 INT, k INT, depth STRING"
EXTRA = (7, "node", 3, "conv", 1, 2, "depth")
SPACES = " \t\n\x0b\x0c\r"


def awkward():
    pick = random.Random(3)
    words = ["Yes.", "No!", "maybe", "why?", "well then.", "", " \n", "a long answer with many words.", "cut off here", "ü é ß."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for c in range(130):
        for t in range(pick.randint(1, 9)):
            rows.append((c, t, roles[t % 2] if pick.random() < 0.75 else pick.choice(roles), pick.choice(words) if pick.random() < 0.4 else f"Turn {pick.randint(0, 4)}."))
    for c in range(300, 330):  # one beginning for many, and many equal conversations
        rows += [(c, 1, "system", "Be brief."), (c, 2, "user", "Hello."), (c, 3, "assistant", "Hello to you.")]
    rows += [(400, t, "user" if t % 2 else "assistant", f"Part {t}.") for t in range(70)]  # one long chain
    rows += [(None, 1, "user", "no id."), (None, None, "assistant", None), (None, 2, None, None), (-41, 1, "user", "below."), (-40, 5, "user", None)]
    rows += [(500, None, "user", "Null turn."), (500, 3, "assistant", "Three."), (500, None, "user", "Null turn."), (501, None, None, None)]
    rows += [(502, 9, "user", "x" * 200_000 + " " + "word " * 50_000 + "."), (2**62, 1, "user", "Far."), (2**62, -(2**62), "assistant", "Near.")]
    return rows


def conversations(spark, rows=None):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([(*row, *EXTRA) for row in rows], SCHEMA).repartition(5)


def hashes(spark, pairs):
    made = spark.createDataFrame(list(pairs), "role STRING, text STRING")
    found = made.select("role", "text", F.xxhash64("role", "text").alias("d1"), F.xxhash64("text", F.lit("|"), "role").alias("d2")).collect()
    return {(r["role"], r["text"]): (r["d1"], r["d2"]) for r in found}


def by_turn(rows, order):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, order[x[1:]]))


def plain_trie(spark, rows):
    order = hashes(spark, {(r or "", x or "") for _, _, r, x in rows})
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t, r or "", x or ""))
    own = {c: [x[1:] for x in by_turn(turns, order)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h, head = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20)) if abs(c) < 2**53 else c - c % 20
        built[c] = (*own.get(head, [])[:h], *turns[h:])
    members, children = defaultdict(list), defaultdict(int)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        children[node[:-1]] += bool(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        worth = (len(convs) - 1) * len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += worth
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], digest))
    return sorted(out, key=str)


@pytest.fixture
def many_tasks(spark):
    """Small shuffles keep all their tasks, so that groups are really cut."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_awkward_conversations(spark):
    rows = awkward()
    found = trie.prefix_trie(conversations(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_trie(spark, rows)


def test_one_conversation_has_most_rows(spark, many_tasks):
    rows = [(20, t, "user", f"t {t}") for t in range(900)] + [(c, t, "user", f"t {t}") for c in range(21, 30) for t in range(6)]
    found = trie.prefix_trie(conversations(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_trie(spark, rows)


def test_conversations_that_lose_all_turns(spark):
    rows = [(c, 1, "user", "only turn") for c in range(21, 40)]  # no conversation 20
    found = trie.prefix_trie(conversations(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_trie(spark, rows)


def test_no_conversation_no_node(spark):
    assert trie.prefix_trie(conversations(spark, [])).collect() == []
    assert trie.prefix_trie(conversations(spark, [(None, 1, "user", "x")])).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb", "forest"])
def test_subtree_sums(spark, shape):
    pick, n = random.Random(5), 300
    above = {
        "chain": lambda k: k - 1,
        "star": lambda k: 0,
        "random": lambda k: pick.randrange(k),
        "comb": lambda k: k - 1 if k % 2 else max(k - 2, 0),
        "forest": lambda k: None if k % 7 == 0 else k - 1,
    }[shape]
    parents = [None, *(above(k) for k in range(1, n))]
    worth = [pick.randint(0, 9) for _ in range(n)]
    sums = list(worth)
    for k in reversed(range(n)):
        if parents[k] is not None:
            sums[parents[k]] += sums[k]
    rows = [(f"n{k}", None if parents[k] is None else f"n{parents[k]}", worth[k], 1) for k in range(n)]
    nodes = spark.createDataFrame(rows, "node STRING, parent STRING, worth BIGINT, one BIGINT")
    found = {r["node"]: r["worth"] for r in trie.subtree_sums(nodes, ["worth", "one"]).collect()}
    assert found == {f"n{k}": sums[k] for k in range(n)}


def test_places_within_a_group_over_several_tasks(spark, many_tasks):
    rows = [("hot", k % 50, "x") for k in range(3000)] + [(f"k{k}", 1, "y") for k in range(40)] + [(None, None, "z")] * 30
    frame = spark.createDataFrame(rows, "name STRING, n INT, other STRING").repartition(7)
    found = numbered(frame, "name", ["n"], "places").collect()
    assert len({r["part"] for r in found if r["name"] == "hot"}) > 1
    for name in {r[0] for r in rows}:
        mine = sorted((r for r in found if r["name"] == name), key=lambda r: r["pos"])
        assert [r["pos"] for r in mine] == list(range(1, sum(r[0] == name for r in rows) + 1))
        assert [r["n"] or 0 for r in mine] == sorted(r["n"] or 0 for r in mine)


def cheapest(rows):
    """(cost, audit, repaired) by trying states one after another, with plain pairs of cost and text."""
    follows = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for role, then in follows[state].items():
                    if role in names:
                        new = (cost + 5, audit + "I", (*out, f"{names[role]}:"))
                        best[then] = min(best.get(then, new), new)
        return best

    best = with_inserts({0: (0, "", ())})
    for role, text, goes, cut in rows:
        after = {}
        for state, (cost, audit, out) in best.items():
            options = [(state, (cost + 2, audit + "D", out))]
            for wanted, then in follows[state].items():
                if goes:
                    continue
                if role[:1] == wanted:
                    options.append((then, (cost + 5 * cut, audit + "K", (*out, f"{role}:{text}"))))
                if wanted in names:
                    options.append((then, (cost + 1 + 5 * cut, audit + "R", (*out, f"{names[wanted]}:{text}"))))
            for then, new in options:
                after[then] = min(after.get(then, new), new)
        best = with_inserts(after)
    return min(best[state] for state in (0, 3) if state in best)


def plain_repair(spark, rows):
    after, everyone = defaultdict(list), {row[0] for row in rows}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        after[c] += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    order = hashes(spark, {x[1:] for turns in after.values() for x in turns})
    out = []
    for c in everyone:
        turns = by_turn(after[c], order)
        counts, seen, marked = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in turns:
            bare = text.strip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, repaired = cheapest(marked)
        out.append((c, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [256, 3])
def test_repair_of_awkward_conversations(spark, block):
    rows = awkward()
    found = mend.repair(conversations(spark, rows), block=block).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_repair(spark, rows)


def test_repair_of_one_long_conversation(spark, many_tasks):
    pick = random.Random(8)
    rows = [(7, t, pick.choice(["user", "assistant", "system"]), f"Turn {pick.randint(0, 900)}{pick.choice(['.', '', '!'])}") for t in range(1500)]
    found = mend.repair(conversations(spark, rows)).collect()
    assert [tuple(r) for r in found] == plain_repair(spark, rows)


def test_repair_of_nothing(spark):
    assert mend.repair(conversations(spark, [])).collect() == []


def test_paths_of_blocks_join_to_those_of_the_whole():
    pick = random.Random(1)
    for _ in range(150):
        symbols = "".join(pick.choices("suaoSUAO-", weights=[1, 5, 5, 1, 1, 1, 1, 1, 2], k=pick.randint(0, 24)))
        whole = mend.solve(symbols)
        paths, width = [(0, 0), None, None, None], 0
        for k in range(0, len(symbols), 5):
            part = symbols[k : k + 5]
            paths, width = mend.join_paths(paths, width, [mend.block_paths(part, s) for s in range(4)], 3 * len(part) + 2)
        assert (mend._solved(paths, width) if symbols else whole) == whole
        rows = [(x.lower(), "t", x == "-", x.isupper()) for x in symbols]
        assert whole == cheapest(rows)[:2]
