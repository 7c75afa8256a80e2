"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(w | h) = P(class | h) P(group | class, h) P(slot | class, group, h). All three factors are softmaxes over
sums of hashed feature weights: the word before, the word before that (a skip feature) and the pair of them.
A factor starts at the unigram frequencies and the features move it from there.
Each has ``arity`` outcomes, so a token costs three short softmaxes however many words there are. The
most frequent words, arity**2 * (arity - 1) of them, have a slot each; every other word belongs to the last
slot of a group by its hash, where it has its add-one share of that slot's training tokens (unseen words
share one).

The model grows with the training tokens N: arity is N**(1/6), so about sqrt(N) words have a slot of their own
(2,000 at 3 million tokens, 9,000 at 80 million, 70,000 at 5 billion), and each factor hashes its features
to a number of rows that grows with N**(1/4). Tasks that train in parallel are as many as keep the
weights they send in proportion to the text.

Counts cover all training tokens. They stay in hash buckets; the words above a count that at most
``HEAD`` words (or those with a slot, where these are more) reach are broadcast, and the counts of all others
come to a document by a bucketed join
of (word, document) against the count table, so no table of all words is ever gathered. Training passes
over all training texts once, in ``ROUNDS`` rounds: tasks take Adagrad steps from the shared weights
over their own texts, and the weights are averaged by tokens after each round.

Words are identified by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DEALT, Scratch, deal, dealt_again, fan, pack, spans, text_buffer, unpack
from .sums import tree_sum

#: Outcomes of a factor at least; feature rows of a factor at a million training tokens, and at least.
ARITY, ROWS = 6, 12_288
ROUNDS = 3
#: Bytes of weights that the training tasks of a round send, as a share of the text's, and such tasks at least.
SENT, TRAINERS = 0.17, 8
STEP = 0.08
BATCH = 20_000
LN10 = float(np.log(10))
#: Words of which the counts are broadcast (12 bytes each).
HEAD = 1 << 17
#: Distinct words that a task counts before it deals them, and tokens of text to a count bucket.
AT_ONCE = 400_000
TOKENS_TO_BUCKET = 6_000_000

#: The end of a text counts as a token; words hold no white space, so this hash is its own.
END = np.int64(np.uint64(xxhash.xxh64_intdigest(b"\n")).astype(np.int64))
_START = np.uint64(0x243F6A8885A308D3)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def tokens(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by END, and the offsets of the texts in them."""
    raw, ends = body.tobytes().lower(), offs.tolist()
    found = []
    for a, z in zip(ends[:-1], ends[1:]):  # a text's words go as soon as they are hashed
        words = raw[a:z].split()
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64))
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in found], dtype=np.int64)])
    out = np.full(int(at[-1]), END, np.int64)
    for x, a in zip(found, at.tolist()):
        out[a : a + len(x)] = x
    return out, at


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


_COUNT, _NEED, _DOC, _SUM = (
    [(t, 1) for t in types]
    for types in ((np.int64, np.int64), (np.int64, np.int64, np.int32), (np.int64, np.int64, np.int8, np.int8, np.int64, np.int64, np.float64, np.float64), (np.int64, np.float64, np.int64))
)
#: Kinds of dealt rows: words with counts or requests by word, documents and their sums by document.
WORD, DOC, SUM = range(3)


def _chunks(column, size: int = 1 << 20):
    body, offs = text_buffer(column)
    for i, j in spans(offs, size):
        yield i, j, *tokens(body[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def count_words(texts: DataFrame, parts: int) -> DataFrame:
    """``texts(text)`` -> ``part, n_words, n_tokens, blob``: each bucket's words (sorted) and counts."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def add():
            key, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return key, np.bincount(back, np.concatenate([h[1] for h in held]), minlength=len(key)).astype(np.int64)

        for b in batches:
            for _, _, tok, _ in _chunks(b.column(0)):
                held.append(np.unique(tok, return_counts=True))
                n += len(held[-1][0])
                if n > 2 * AT_ONCE:
                    held = [add()]
                    n = len(held[0][0])
                    if n > AT_ONCE:
                        yield deal(WORD, _part(held[0][0], parts) // fan(parts), *held[0])
                        held, n = [], 0
        if held:
            key, count = add()
            yield deal(WORD, _part(key, parts) // fan(parts), key, count)

    def bucket(table: pa.Table) -> pa.Table:
        key, n = unpack([x.as_py() for x in table.column("blob")], _COUNT)
        key, back = np.unique(key, return_inverse=True)
        n = np.bincount(back, n, minlength=len(key)).astype(np.int64)
        return pa.table({"part": table.column("part")[:1], "n_words": pa.array([len(key)], pa.int64()), "n_tokens": pa.array([int(n.sum())], pa.int64()), "blob": pa.array([pack(key, n)], pa.binary())})

    dealt = dealt_again(texts.mapInArrow(run, DEALT), parts, {WORD: (_COUNT, lambda key, _: _part(key, parts))})
    return dealt.groupBy("part").applyInArrow(bucket, "part int, n_words long, n_tokens long, blob binary")


def head_of(counts: DataFrame, size: int = HEAD) -> tuple[np.ndarray, np.ndarray, int]:
    """The words above the smallest count that at most ``size`` words reach: hashes (sorted), counts and
    that count less one (0: all words are in it)."""

    def steps(batches):
        for b in batches:
            for x in b.column("blob"):
                v, n = np.unique(unpack([x.as_py()], _COUNT)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], names=["n", "words"])

    least, words = None, 0
    for r in counts.mapInArrow(steps, "n long, words long").groupBy("n").agg(F.sum("words").alias("words")).orderBy(F.desc("n")).limit(size + 1).collect():
        words += r["words"]
        if words > size:
            break
        least = r["n"]
    else:
        least = 1
    least = least if least is not None else np.iinfo(np.int64).max

    def pick(batches):
        for b in batches:
            for x in b.column("blob"):
                key, n = unpack([x.as_py()], _COUNT)
                yield pa.RecordBatch.from_arrays([pa.array([pack(key[n >= least], n[n >= least])], pa.binary())], names=["blob"])

    key, n = unpack([r["blob"] for r in counts.mapInArrow(pick, "blob binary").collect()], _COUNT)
    order = np.argsort(key)
    return key[order], n[order], int(least) - 1


class Shape:
    """Sizes of the model, and classes, groups and slots of words. A word's group is its class times
    ``arity`` and its place in it."""

    def __init__(self, key: np.ndarray, count: np.ndarray, tokens: int):
        self.arity = max(ARITY, int(np.ceil(max(tokens, 1) ** (1 / 6))))
        self.rows = int(ROWS * max(1.0, (tokens / 1e6) ** 0.25))
        self.groups, self.rest = self.arity**2, self.arity - 1
        top = np.lexsort((key, -count))[: self.groups * self.rest]
        rank = np.arange(len(top))
        order = np.argsort(key[top])
        self.key = key[top][order]
        self.group = (rank % self.groups)[order].astype(np.int64)
        self.slot = (rank // self.groups)[order].astype(np.int64)
        self.count = count[top][order]
        self.prior(np.zeros((2, self.groups)))

    def prior(self, rest: np.ndarray) -> None:
        """Set log frequencies of the outcomes from the words' counts and ``rest``, the tokens and distinct
        words of every group's last slot. A slot without a word gets next to nothing."""
        n = np.full((self.groups, self.arity), 1e-3)
        n[self.group, self.slot] = self.count + 1.0
        n[:, self.rest] = rest.sum(axis=0) + 1
        self.rest_log = np.log10(n[:, self.rest])
        by_group = n.sum(axis=1)
        by_class = by_group.reshape(self.arity, -1).sum(axis=1)
        levels = (by_class / by_class.sum(), by_group.reshape(self.arity, -1).T / by_class, n.T / by_group)
        self.bias = [np.log(x.reshape(self.arity, -1)).astype(np.float32) for x in levels]

    @property
    def size(self) -> int:
        return 3 * self.rows * self.arity

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, slot) of distinct words."""
        group = ((words.view(np.uint64) * _MIX[0]) >> np.uint64(24)).astype(np.int64) % self.groups
        slot = np.full(len(words), self.rest)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, words), len(self.key) - 1)
            hit = self.key[at] == words
            group[hit], slot[hit] = self.group[at[hit]], self.slot[at[hit]]
        return group, slot

    def factors(self, feats: np.ndarray, group: np.ndarray, slot: np.ndarray):
        """For each factor its feature rows, log frequencies, which of these hold, and outcomes; later factors
        are given what came before."""
        first = group // self.arity
        yield (feats % np.uint64(self.rows)).astype(np.int32), self.bias[0], np.zeros_like(first), first
        for bias, given, mark, y in ((self.bias[1], first, 1, group % self.arity), (self.bias[2], group, self.arity + 1, slot)):
            mixed = (feats ^ (given + mark).astype(np.uint64) * _MIX[2]) * _MIX[3]
            yield ((mixed >> np.uint64(20)) % np.uint64(self.rows)).astype(np.int32), bias, given, y

    def split(self, flat: np.ndarray) -> np.ndarray:
        """Weights by factor, outcome and feature row: what runs over a batch is contiguous."""
        return flat[: self.size].reshape(3, self.arity, self.rows)


def features(tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of every token's history, [3, tokens]; texts start after two start marks."""
    t = tok.view(np.uint64)
    one, two = np.full(len(t), _START), np.full(len(t), _START)
    one[1:], two[2:] = t[:-1], t[:-2]
    one[at[:-1]] = _START
    two[at[:-1]] = _START
    second = at[:-1] + 1
    two[second[second < at[1:]]] = _START
    a = one * _MIX[1]
    b = (two ^ _MIX[2]) * _MIX[3]
    pair = (a ^ (b >> np.uint64(17))) * _MIX[2]
    return np.stack([a >> np.uint64(20), b >> np.uint64(20), pair >> np.uint64(20)])


def _logits(table: np.ndarray, rows: np.ndarray, bias: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Logits [outcomes, tokens], less the greatest of each token."""
    z, more = np.empty((len(table), rows.shape[1]), table.dtype), np.empty(rows.shape[1], table.dtype)
    rows = rows.astype(np.intp, copy=False)
    start = bias.astype(table.dtype, copy=False)
    for out, own, first in zip(z, table, start):
        own.take(rows[0], out=out, mode="clip")
        for source, at in ((own, rows[1]), (own, rows[2]), (first, given)):
            out += source.take(at, out=more, mode="clip")
    z -= z.max(axis=0)
    return z


def _softmax(table: np.ndarray, rows: np.ndarray, bias: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Probabilities [outcomes, tokens]."""
    z = _logits(table, rows, bias, given)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def _slopes(p: np.ndarray, rows: np.ndarray, truth: np.ndarray, size: int):
    """Gradient by feature row (float64), one outcome after another."""
    n = len(truth)
    p[truth, np.arange(n)] -= 1
    flat, thrice = rows.reshape(-1).astype(np.intp, copy=False), np.empty((3, n))
    for own in p:
        thrice[:] = own
        yield np.bincount(flat, thrice.reshape(-1), minlength=size)


def _gradient(p: np.ndarray, rows: np.ndarray, truth: np.ndarray, size: int) -> np.ndarray:
    """Gradient by outcome and feature row."""
    return np.stack([g.astype(p.dtype) for g in _slopes(p, rows, truth, size)])


def _step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, bias: np.ndarray, given: np.ndarray, truth: np.ndarray) -> None:
    """An Adagrad step over a batch, in place: outcome by outcome, so that no array as large as the table is made."""
    rows = rows.astype(np.intp)
    g, scale = np.empty(table.shape[1], table.dtype), np.empty(table.shape[1], table.dtype)
    for own, total, slope in zip(table, seen, _slopes(_softmax(table, rows, bias, given), rows, truth, len(g))):
        g[:] = slope
        np.multiply(g, g, out=scale)
        total += scale
        np.sqrt(total, out=scale)
        g *= STEP
        g /= scale
        own -= g


def train(texts: DataFrame, shape: Shape, chars: int) -> np.ndarray:
    """``texts(text, turn)`` with turn below ROUNDS, of about ``chars`` bytes -> weights (flat float32)."""
    context = texts.sparkSession.sparkContext
    flat = np.zeros(shape.size, np.float32)
    tasks = max(TRAINERS, int(SENT * chars / flat.nbytes))
    for turn in range(ROUNDS):
        sent = context.broadcast((shape, flat))

        def run(batches, sent=sent):
            shape, flat = sent.value
            start = shape.split(flat)
            tables, seen, n = start.copy(), np.ones(start.shape, np.float32), 0
            for b in batches:
                for _, _, tok, at in _chunks(b.column(0), 1 << 19):
                    feats = features(tok, at)
                    words, back = np.unique(tok, return_inverse=True)
                    group, slot = (x[back] for x in shape.of(words))
                    for i in range(0, len(tok), BATCH):
                        cut = slice(i, i + BATCH)
                        for table, s, (rows, bias, given, y) in zip(tables, seen, shape.factors(feats[:, cut], group[cut], slot[cut])):
                            _step(table, s, rows, bias, given, y)
                    n += len(tok)
            if n:
                total = np.append(((tables - start) * n).reshape(-1), np.float32(n))
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part"])

        mine = texts.where(F.col("turn") == turn).select("text").coalesce(tasks)
        got = tree_sum(mine.mapInArrow(run, "part binary"), shape.size + 1, np.float32)
        sent.unpersist()
        if got[-1]:
            flat = (flat + got[:-1] / got[-1]).astype(np.float32)
    return flat


def log10(flat: np.ndarray, shape: Shape, tok: np.ndarray, at: np.ndarray, group: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """log10 P(group, slot | history) of every token, in sparse batches."""
    feats = features(tok, at)
    out = np.zeros(len(tok))
    for i in range(0, len(tok), BATCH):
        cut = slice(i, i + BATCH)
        for table, (rows, bias, given, y) in zip(shape.split(flat), shape.factors(feats[:, cut], group[cut], slot[cut])):
            z = _logits(table, rows, bias, given)
            own = z[y, np.arange(len(y))].astype(float)
            out[cut] += np.maximum((own - np.log(np.exp(z, out=z).sum(axis=0))) / LN10, -30)
    return out


def _rest(counts: DataFrame, shape: Shape) -> np.ndarray:
    """Tokens and distinct words of every group's last slot, [2, groups]."""

    def run(batches):
        total = np.zeros((2, shape.groups))
        for b in batches:
            for x in b.column("blob"):
                key, n = unpack([x.as_py()], _COUNT)
                group, slot = shape.of(key)
                last = slot == shape.rest
                total += [np.bincount(group[last], n[last], minlength=shape.groups), np.bincount(group[last], minlength=shape.groups)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return tree_sum(counts.mapInArrow(run, "part binary"), 2 * shape.groups).reshape(2, shape.groups)


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", turn: Column | None = None, head_size: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``df``.

    base_score is the add-one unigram log10 probability, score the model's. Ids are integers; null ids,
    null texts (read as empty) and repeated rows count like any other. Without training rows every word
    is unseen and the model is uniform over classes and groups.
    """
    scratch = Scratch(df.sparkSession, "lm")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turn = turn if turn is not None else F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("turn")), F.lit(ROUNDS))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text.alias("text"), turn.alias("turn"))
    learnt = docs.where("not held_out")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-chars // (6 * TOKENS_TO_BUCKET)))
    counts = scratch.table(count_words(learnt.select("text"), parts))
    size = counts.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    n_train, n_words = int(size[0] or 0), int(size[1] or 0)
    own_words = int(max(1, n_train) ** 0.5)
    key, count, tail_below = head_of(counts, max(head_size, 2 * own_words) if head_size else 0)
    shape = Shape(key, count, n_train)
    shape.prior(_rest(counts, shape))
    model = df.sparkSession.sparkContext.broadcast((shape, train(learnt, shape, chars)))
    log_head = np.log10(count + 1.0)
    log_all = np.log10(n_train + (n_words + 1.0))

    def local(batches):
        shape, weights = model.value
        serial = (TaskContext.get().partitionId() + 1) << 40
        for b in batches:
            ids, held = b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            have = np.array(ids.is_valid().to_numpy(zero_copy_only=False), np.int8)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for i, j, tok, at in _chunks(b.column(2)):
                words, back = np.unique(tok, return_inverse=True)
                group, slot = shape.of(words)
                found = np.zeros(len(words), bool)
                logs = np.zeros(len(words))
                if len(key):
                    pos = np.minimum(np.searchsorted(key, words), len(key) - 1)
                    found = key[pos] == words
                    logs[found] = log_head[pos[found]]
                tail = ~found & (tail_below > 0)
                share = np.where(slot == shape.rest, logs - shape.rest_log[group], 0.0)  # tail counts follow by the join
                own = log10(weights, shape, tok, at, group[back], slot[back]) + share[back]
                uid = serial + np.arange(j - i)
                serial += j - i
                doc = np.repeat(np.arange(j - i), np.diff(at))
                n = np.diff(at)
                base = np.add.reduceat(logs[back], at[:-1]) - n * log_all
                known = np.add.reduceat(found[back].astype(np.int64), at[:-1])
                yield deal(DOC, uid % parts // fan(parts), uid, number[i:j], have[i:j], held[i:j], n, known, base, np.add.reduceat(own, at[:-1]))
                need = np.flatnonzero(tail[back])
                if len(need):
                    order = need[np.lexsort((tok[need], doc[need]))]
                    w, d = tok[order], doc[order]
                    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])]))
                    times = np.diff(np.append(new, len(w))).astype(np.int32)
                    yield deal(WORD, _part(w[new], parts) // fan(parts), w[new], uid[d[new]], times)

    by_doc = lambda uid, *_: uid % parts
    owners = {WORD: (_NEED, lambda word, *_: _part(word, parts)), DOC: (_DOC, by_doc), SUM: (_SUM, by_doc)}
    dealt = scratch.table(dealt_again(docs.select("doc_id", "held_out", "text").mapInArrow(local, DEALT), parts, owners))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = deal(SUM, np.zeros(0, np.int64), *[np.zeros(0, t) for t, _ in _SUM])
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([empty])
        word, uid, times = unpack([x.as_py() for x in left.column("blob")], _NEED)
        own, n = unpack([x.as_py() for x in right.column("blob")], _COUNT)
        at = np.minimum(np.searchsorted(own, word), len(own) - 1)
        hit = own[at] == word
        uid, times, logs = uid[hit], times[hit], np.log10(n[at[hit]] + 1.0)
        who, back = np.unique(uid, return_inverse=True)
        sums = np.bincount(back, times * logs, minlength=len(who))
        known = np.bincount(back, times, minlength=len(who)).astype(np.int64)
        return pa.Table.from_batches([deal(SUM, who % parts // fan(parts), who, sums, known)])

    needs = dealt.where(f"kind = {WORD}").groupBy("part")
    more = needs.cogroup(counts.select("part", "blob").groupBy("part")).applyInArrow(look_up, DEALT)
    more = dealt_again(more, parts, owners)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        blob = table.column("blob").to_pylist()
        uid, ids, have, held, n, known, base, own = unpack([x for x, k in zip(blob, kind) if k == DOC], _DOC)
        who, sums, extra = unpack([x for x, k in zip(blob, kind) if k == SUM], _SUM)
        order = np.argsort(uid)
        at = order[np.searchsorted(uid, who, sorter=order)] if len(who) else np.zeros(0, np.int64)
        add = np.bincount(at, sums, minlength=len(uid))
        known = known + np.bincount(at, extra, minlength=len(uid)).astype(np.int64)
        cols = [pa.array(ids, mask=have == 0), pa.array(held == 1), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_train)), pa.array(base + add), pa.array(own + add)]
        return pa.table(dict(zip(names, cols)))

    both = dealt.where(f"kind = {DOC}").unionByName(more)
    return both.groupBy("part").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
