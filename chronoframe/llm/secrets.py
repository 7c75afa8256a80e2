"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base candidates come from three patterns. Bare tokens (long, with upper case, lower case and a
digit) are candidates too, but a shape alone says little: the hash of every candidate is counted
over the distinct repositories and owners of the whole corpus. A value that many owners hold, or that is
spread over many repositories, is a copied example; one of few owners and repositories looks live. Bare
tokens become spans only when they look live; base spans always stay and carry the same class.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# The kinds in their order, their patterns, and the length each match must reach.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9_-]{20,}"
ASSIGN_VALUE = 12
#: From so many distinct owners on, a value counts as a widely copied example.
SHARED_OWNERS = 3
#: From so many distinct repositories on it does too, even where they belong to one or two owners.
SHARED_REPOS = 6


def _found(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """Matches as array<struct<start, kind, end, value>>, in code points, end exclusive.

    Between the matches lie the pieces of a split by the same pattern, so positions are running sums
    of both lengths. Rows without a match pay one scan.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value"))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["gap"])
        end = start + F.coalesce(F.length(row["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), row["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(row["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    walked = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(F.rlike(text, F.lit(pattern)), walked).otherwise(empty)


def candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``bare`` candidate arrays (columns of those names are replaced); null text
    reads as empty.

    ACCESS and HEX state their length in the pattern, which keeps the same matches as dropping short
    ones (a shorter run cannot hold a longer match). ASSIGN consumes short values, so those are
    dropped afterwards.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("base", "bare")]
    out = df.select(*rest, F.filter(_found(text, 0, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_VALUE).alias("_a"), _found(text, 1, ACCESS).alias("_k"), _found(text, 2, HEX).alias("_h"), _found(text, 3, TOKEN).alias("_t"))
    out = out.withColumn("base", F.array_sort(F.concat("_a", "_k", "_h")))

    def lone(s: Column) -> Column:
        mixed = F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[A-Z]")) & F.rlike(s["value"], F.lit("[a-z]"))
        return mixed & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return out.withColumn("bare", F.filter("_t", lone)).drop("_a", "_k", "_h", "_t")


def ownership(found: DataFrame) -> DataFrame:
    """``found(hash, owner, repo)`` -> ``(hash, n_rows, n_repos, n_owners)``.

    Three aggregates, each combined on the map side, so a value that a third of all rows hold
    shuffles as one row for each task. A null owner or repository counts as one of its own.
    """
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def _classed(rows: DataFrame, shared_owners: int, shared_repos: int) -> DataFrame:
    """Rows with ``_row, owner, repo, base, bare`` -> ``(_row, spans)``, spans with their class and counts.

    Bare tokens of shared values are left out here; rows without a candidate have no row.
    """
    each = rows.select("_row", "owner", "repo", F.explode(F.concat("base", "bare")).alias("s")).withColumn("hash", F.xxhash64("s.value"))
    counts = ownership(each.select("hash", "owner", "repo")).withColumn("live", (F.col("n_owners") < shared_owners) & (F.col("n_repos") < shared_repos))
    each = each.select("_row", "hash", "s").join(counts.select("hash", "live", "n_owners", "n_repos"), "hash").where(F.col("live") | (F.col("s.kind") < 3))
    span = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("live").alias("live"), F.col("n_owners").alias("owners"), F.col("n_repos").alias("repos"))
    return each.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _text_of(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", shared_owners: int = SHARED_OWNERS, shared_repos: int = SHARED_REPOS) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, n_assign, n_access, n_hex, n_token, n_live, n_shared,
    most_owners, most_repos, base_sha256, spans``.

    n_assign, n_access and n_hex count base spans, n_token added ones; n_live and n_shared split all
    spans by ownership; most_owners and most_repos are the counts of the row's most spread value (0 without
    a span). A repository is (owner_col, repo_col). Null or empty text has no spans and the
    sha256 of the empty string. Ids may be null or repeated; other columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "secrets")
    rows = candidates(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo")))
    rows = scratch.table(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "owner", "repo", "base", "bare"))
    spans = _classed(rows.where(F.size("base") + F.size("bare") > 0), shared_owners, shared_repos)
    out = rows.join(spans, "_row", "left").withColumn("spans", F.coalesce("spans", F.array()))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return out.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.size(F.filter("spans", lambda s: s["kind"] == 3)).cast("bigint").alias("n_token"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("bigint").alias("n_shared"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["owners"])), F.lit(0)).cast("bigint").alias("most_owners"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["repos"])), F.lit(0)).cast("bigint").alias("most_repos"),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", shared_owners: int = SHARED_OWNERS, shared_repos: int = SHARED_REPOS, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every live-looking span of its text replaced by ``mark``; all rows and columns stay.

    Rows without a candidate, and null texts, pass as they are. Values that many owners hold are
    examples and stay. Overlapping spans are replaced once, from the first start to the last end.
    """
    scratch = Scratch(df.sparkSession, "redact")
    names = df.columns
    own = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_own")
    found = candidates(df.select(own, F.col(f"`{text_col}`").alias("_text"), F.col(f"`{owner_col}`").alias("owner"), F.col(f"`{repo_col}`").alias("repo")), "_text")
    # one table of all rows, so that the patterns are searched once; it holds the text once, in _own
    found = scratch.table(found.select(F.monotonically_increasing_id().alias("_row"), "_own", "owner", "repo", "base", "bare"))
    some = F.size("base") + F.size("bare") > 0
    kept = found.where(~some).select("_own.*")
    hit = found.where(some).withColumn("_text", F.coalesce(F.col(f"_own.`{text_col}`").cast("string"), F.lit("")))
    live = _classed(hit, shared_owners, shared_repos).select("_row", F.filter("spans", lambda s: s["live"]).alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.col("_text").substr(acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = lambda acc: F.concat(acc["out"], F.col("_text").substr(acc["at"] + 1, F.length("_text") - acc["at"]))
    cut = F.aggregate(F.coalesce("spans", F.array()), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, done)
    hit = hit.join(live, "_row", "left").withColumn("_new", cut)
    hit = hit.select(*[(F.col("_new") if c == text_col else F.col(f"_own.`{c}`")).alias(c) for c in names])
    return kept.unionByName(hit)


#: The same pattern with both cases spelled out, for engines whose (?i) also folds letters beyond ASCII.
_ASSIGN_SQL = re.sub(r"(?<![\\x])[a-z](?![0-9])", lambda m: f"[{m[0].upper()}{m[0]}]", ASSIGN.removeprefix("(?i)").partition("[:=]")[0]) + "[:=]" + ASSIGN.partition("[:=]")[2]
_ASSIGN_SQL = _ASSIGN_SQL.replace("'", "''")

ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source AS owner, lang AS repo FROM documents
), m AS (
  SELECT rid, doc_id, owner, repo, 0 AS kind, string_split_regex(t, '{_ASSIGN_SQL}') AS g,
         regexp_extract_all(t, '{_ASSIGN_SQL}', 0) AS h, regexp_extract_all(t, '{_ASSIGN_SQL}', 2) AS v FROM d
  UNION ALL SELECT rid, doc_id, owner, repo, 1, string_split_regex(t, '{ACCESS}'), regexp_extract_all(t, '{ACCESS}', 0), regexp_extract_all(t, '{ACCESS}', 0) FROM d
  UNION ALL SELECT rid, doc_id, owner, repo, 2, string_split_regex(t, '{HEX}'), regexp_extract_all(t, '{HEX}', 0), regexp_extract_all(t, '{HEX}', 0) FROM d
  UNION ALL SELECT rid, doc_id, owner, repo, 3, string_split_regex(t, '{TOKEN}'), regexp_extract_all(t, '{TOKEN}', 0), regexp_extract_all(t, '{TOKEN}', 0) FROM d
), e AS (
  SELECT rid, doc_id, owner, repo, kind, g, h, v, unnest(generate_series(1, len(h))) AS i FROM m WHERE len(h) > 0
), s AS (
  SELECT rid, doc_id, owner, repo, kind, v[i] AS value, length(h[i]) AS n,
         coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS a
  FROM e
), b AS (
  SELECT rid, doc_id, owner, repo, kind, value, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS z FROM s WHERE kind <> 0 OR length(value) >= {ASSIGN_VALUE}
), c AS (
  SELECT * FROM b WHERE kind < 3
  UNION ALL
  SELECT * FROM b AS t WHERE kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')
    AND NOT EXISTS (SELECT 1 FROM b AS o WHERE o.kind < 3 AND o.rid = t.rid AND o.a < t.z AND t.a < o.z)
), f AS (
  SELECT value, count(DISTINCT (owner IS NULL, coalesce(owner, ''))) AS owners,
         count(DISTINCT (owner IS NULL, coalesce(owner, ''), repo IS NULL, coalesce(repo, ''))) AS repos FROM c GROUP BY value
), l AS (
  SELECT c.*, owners, repos, owners < {SHARED_OWNERS} AND repos < {SHARED_REPOS} AS live, list_extract(['assign', 'access', 'hex', 'token'], kind + 1) || ':' || a || ':' || z AS w FROM c JOIN f USING (value)
), r AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         count(*) FILTER (kind = 3 AND live) AS n_token, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND kind < 3) AS n_shared,
         max(owners) FILTER (kind < 3 OR live) AS most_owners, max(repos) FILTER (kind < 3 OR live) AS most_repos,
         string_agg(w, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(w, ',' ORDER BY a, kind) FILTER (kind < 3 OR live) AS spans
  FROM l GROUP BY rid
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_token, 0) AS n_token,
       coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (rid)
"""
