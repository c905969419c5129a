import hashlib
import random
import zlib
from collections import defaultdict

from shotloom.llm import prefix_trie


def brute(rows):
    """Nodes by their prefixes as tuples, from (conv_id, turn, role, text); ties of a turn by digest."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    conv = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    new = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = conv.get(c - c % 100, [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in sorted(new.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in kids[k])
        ends = ",".join(str(c) for c in members[k] if len(new[c]) == len(k))
        out.append((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def check(spark, rows, schema="conv_id long, turn long, role string, text string", extra=()):
    table = spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3)
    got = prefix_trie.build_trie(table)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == want
    return want


def test_shared_prefixes_and_copies(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 215)]:
        n = rng.choice((1, 2, 3, 8))
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(("hi", "yes", "né\U0001f600", "no " * 9))) for t in range(n)]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 340) for t in range(12)]
    want = check(spark, rows)
    assert max(r[3] for r in want) > 70 and max(r[1] for r in want) >= 12


def test_odd_rows(spark):
    rows = [(7, None, None, "first"), (7, None, "user", None), (7, 3, "user", "x"), (7, 3, "user", "x"), (7, 3, "bot", "x"), (7, 1, None, None), (None, 0, "user", "nobody")]
    rows += [(103, 0, "user", "gone"), (-5, 2, "user", "y" * 70_000), (-5, -2, "user", ""), (4, 2000, "user", "far"), (4, 5, "user", "near"), (4, -3000, "user", "early")]
    rows += [(104, k, "user", f"{k}") for k in range(300)] + [(5, k, "user", f"{k}") for k in range(300)]
    check(spark, rows, "conv_id long, turn long, role string, text string, node long, depth string, rep int", (1, "d", None))


def test_one_class_and_turnless(spark):
    # 24 takes over five turns of an absent base and has none left
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert check(spark, [(lone, 0, "user", "a")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    check(spark, [(c, t, "user", f"{t}") for c in (200, 300) for t in range(9)])


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefix_trie.build_trie(table).count() == 0


def test_ids_cross_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_RANGE", 64)
    check(spark, [(c, 0, "user", "same") for c in range(0, 1000, 3)] + [(c, 0, "user", f"{c % 2}") for c in range(1, 1000, 3)])
