import hashlib
import random
import re
from collections import defaultdict

import duckdb

from chronoframe.llm.secrets import ORACLE, redact, scan

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]


def base(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            if (len(m[2]) >= 12) if k == 0 else len(m[0]) >= (18 if k == 1 else 16):
                out.append((m.start(), k, m.end(), m[2] if k == 0 else m[0]))
    return sorted(out)


def brute(rows):
    """rows: (doc_id, text, source, lang) -> the query's rows."""
    found, owners, repos = [], defaultdict(set), defaultdict(set)
    for _, text, owner, lang in rows:
        b = base(text)
        t = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9_-]{20,}", text or "") if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
        t = [s for s in t if not any(o[0] < s[2] and s[0] < o[2] for o in b)]
        found.append((b, t))
        for s in b + t:
            owners[s[3]].add(owner)
            repos[s[3]].add((owner, lang))
    names = ["assign", "access", "hex", "token"]
    say = lambda spans: ",".join(f"{names[k]}:{a}:{z}" for a, k, z, _ in sorted(spans))
    out = []
    for (i, *_), (b, t) in zip(rows, found):
        live = lambda s: len(owners[s[3]]) < 3 and len(repos[s[3]]) < 6
        t = [s for s in t if live(s)]
        most = [max((len(x[s[3]]) for s in b + t), default=0) for x in (owners, repos)]
        n = [sum(s[1] == k for s in b) for k in range(3)]
        out.append((i, *n, len(t), sum(map(live, b + t)), sum(not live(s) for s in b), *most, hashlib.sha256(say(b).encode()).hexdigest(), say(b + t)))
    return out


def corpus():
    rng = random.Random(5)
    bits = ["password", "PassWD", "secret", "token", "API_KEY", "apikey", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "é😀", "\n", "x", "Zz9_", "Tok3nLongEnoughToCount1", ".", "/", "K", "ſecret"]
    rows = [(None, "token=abcdefghijkl", "s", None), (1, None, None, None), (2, "", "a", "b"), (3, "é😀 AKIAABCD1234EFGH56 " * 300, "a", "b"), (4, "w " * 40000, "a", "b")]
    rows += [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "y"])) for k in range(10, 300)]
    rows += [(400 + k, f"vendored secret: onlyOneOwnerManyRepos{k % 2}", "big", f"r{k // 2 if k % 2 else 0}") for k in range(14)]
    return rows + [(7, rows[0][1], "s", None)] * 2


def test_scan_matches_python_regexes_and_sql(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, source string, lang string, value string, base int")
    got = scan(df)
    key = lambda r: tuple(map(str, r))
    mine = sorted((tuple(r) for r in got.collect()), key=key)
    assert mine == sorted(brute(rows), key=key)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar, lang varchar)")
    con.executemany("insert into documents values (?,?,?,?)", rows)
    assert sorted(con.execute(ORACLE).fetchall(), key=key) == mine


def test_redact_cuts_live_values_only(spark):
    shared = [(k, "see token=examplevalue1234 ok", f"o{k}", "x") for k in range(3)]
    rows = shared + [(9, "é password: 'hunter2hunter2x' and 0123456789abcdef0 end", "o9", None), (10, None, None, None), (11, "clean", "o1", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    assert got[0] == rows[0][1] and got[10] is None and got[11] == "clean"
    assert got[9] == "é [SECRET]' and [SECRET] end"
    assert redact(df).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert scan(df).count() == 0 and redact(df).count() == 0
