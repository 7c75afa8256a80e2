import random
from itertools import combinations

import xxhash

from chronoframe.llm.simhash import _BLOCKS, LEAST_SHARED, fingerprint, fingerprints, links, near_duplicates
from chronoframe.llm.common import Scratch


def brute(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(rows, bits=2):
    fps = [(i, brute(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= bits:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, f"{f:016x}", least.get(root(k))) for k, (i, f) in enumerate(fps)), key=str)


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for t in ["", " \n", "One", "one TWO", "A b c", "É à b c d\x1ce"] + [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(50)]:
        assert fingerprint(t.encode()) == brute(t)


def test_shared_postings_tell_shared_bytes():
    for differing, least in LEAST_SHARED.items():
        for gone in combinations(range(8), differing):
            assert sum(not set(gone) & set(b) for b in _BLOCKS) == least
    for gone in combinations(range(8), 3):  # five shared bytes stay below the minimum for two bits
        assert sum(not set(gone) & set(b) for b in _BLOCKS) == 1


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randint(0, 50)) for _ in range(150)) for _ in range(8)]
    rows = [(None, "x y z"), (5, None), (3, ""), (9, "x y z"), (9, "x y z"), (40, "big " * 30000)]
    for k in range(200):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
        rows.append((1000 - k, " ".join(w)))
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    for wide in (32, 2):
        got = near_duplicates(df, wide=wide).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted((tuple(r) for r in got), key=str) == groups(rows)


def test_full_postings_link_like_slim_ones(spark):
    rng = random.Random(3)
    fps = {0, -1, 1 << 62}
    for _ in range(4):
        c = rng.getrandbits(64)
        for _ in range(60):
            x = c
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    pairs = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    slim = {tuple(r) for r in links(df, Scratch(spark, "t"), wide=10**6).collect()}
    assert slim == pairs

    def comps(edges):
        p = {x: x for x in fps}

        def root(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in edges:
            p[root(a)] = root(b)
        out = {}
        for x in fps:
            out.setdefault(root(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    assert comps([tuple(r) for r in links(df, Scratch(spark, "t"), wide=1).collect()]) == comps(pairs)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    assert fingerprints(df).count() == 0
