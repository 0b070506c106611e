"""Language-model scoring by cross-entropy difference.

A target and a background model of the same order, smoothing and vocabulary: words, and the pairs of words that the
corpus holds often enough.  Both are counted over all documents, so they grow with the corpus, and no task ever holds
them whole.  Documents are dealt into chunks.  A chunk sends its different n-grams once, in sorted blocks by range of
their code; the task of a range adds up what all chunks sent and returns the sums in the same order; the chunk then
scores its documents.  So a frequent n-gram is a row a chunk, whatever it occurs, and nothing is joined a token.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token is a run of letters and digits, or any other character that is not blank, in lower case.
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\x20\x09-\x0d]")
#: A pair of words is in the shared vocabulary if the corpus holds it so often; the others back off to the word alone.
MIN_SEEN = 100
#: Tokens that the lower order weighs as prior: of a word its share among all, of a pair the word's probability.
WORD_PRIOR, PAIR_PRIOR = 1e6, 1e3
#: Bytes of text in a chunk; n-grams that a range adds up, repeats in other chunks included, 8 to 40 bytes each.
CHUNK_BYTES, GRAMS_A_RANGE = 6_000_000, 1_000_000
#: Codes of the end of a text, which is also the context of its first word, and of the sum over all words.
END, EVERY = 13, 5
MIX = 0x9E3779B97F4A7C15


class Types(dict):
    """The different tokens of a chunk, numbered as they come, the end of a text first."""

    def __init__(self):
        self.codes = [END]

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self.codes)
        self.codes.append(xxhash.xxh64_intdigest(token) | 1)
        return n


class Chunk:
    """The n-grams of some texts: ``keys``, different codes in order; ``word``, ``pair``, ``context``: each event's place among them.

    Each text's events are its words and its end; the end counts, but is not scored.
    """

    def __init__(self, texts: list[str | None]):
        types, found = Types(), []
        for t in texts:
            found.append(np.fromiter(map(types.__getitem__, TOKEN.findall((t or "").lower().encode())), np.int64))
        self.n = np.array([len(x) for x in found], np.int64)
        now = np.concatenate([y for x in found for y in (x, [0])] or [np.zeros(0)]).astype(np.int64)
        before = np.concatenate(([0], now[:-1]))[: len(now)]
        code = np.array(types.codes, np.uint64)
        pair, which = np.unique(before * len(code) + now, return_inverse=True)
        a, b = code[pair // len(code)], code[pair % len(code)]
        pair = (a * np.uint64(MIX) ^ (b + (a >> np.uint64(7)))) & ~np.uint64(1)
        keys = np.concatenate((code, pair, [np.uint64(EVERY)])).astype(np.uint64)
        self.keys, place = np.unique(keys, return_inverse=True)
        self.word, self.context, self.pair, self.every = place[now], place[before], place[len(code) : -1][which], place[-1]
        self.doc = np.repeat(np.arange(len(texts)), self.n + 1)

    def counts(self, of: np.ndarray | None = None) -> np.ndarray:
        """By key: how often it occurs in all texts, or in those where ``of`` is true."""
        some = slice(None) if of is None else of[self.doc]
        n = np.bincount(self.word[some], minlength=len(self.keys)) + np.bincount(self.pair[some], minlength=len(self.keys))
        n[self.every] = (self.n + 1).sum() if of is None else (self.n + 1)[of].sum()
        return n

    def own(self, key: np.ndarray, some: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
        """Of the events ``some``: how often their ``key`` is a ``held`` one (itself, by default) in the same text."""
        m, held = len(self.keys), key if held is None else held
        here = np.isin(self.doc, np.unique(self.doc[some])) if len(some) < len(self.doc) else np.ones(len(self.doc), bool)
        code, n = np.unique(self.doc[here] * m + held[here], return_counts=True)
        at = np.searchsorted(code, self.doc[some] * m + key[some])
        at[at == len(code)] = 0
        return np.where(code[at] == self.doc[some] * m + key[some], n[at], 0) if len(code) else np.zeros(len(some), np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes of ``x`` by significance, which the shuffle's compression makes small for sorted or small numbers."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def losses(chunk: Chunk, n: np.ndarray, t: np.ndarray, target: np.ndarray, min_seen: int) -> tuple[np.ndarray, ...]:
    """By text: words, mean losses under target and background, and the share of its pairs that other texts hold."""
    every = float(n[chunk.every])
    vocabulary = n[chunk.pair] >= min_seen
    shape = (chunk.word, chunk.context, chunk.pair)
    at = np.flatnonzero(target[chunk.doc])
    out = []
    for totals, leave in ((t, True), (n, False)):
        word, context, pair = (totals[x].astype(np.float64) for x in shape)
        whole = np.full(len(word), float(totals[chunk.every]))
        if leave and len(at):
            # No text's own words are in the target model that scores it.
            word[at] -= chunk.own(chunk.word, at)
            context[at] -= chunk.own(chunk.context, at)
            pair[at] -= chunk.own(chunk.pair, at)
            whole[at] -= (chunk.n + 1)[chunk.doc[at]]
        p = (word + WORD_PRIOR / every) / (whole + WORD_PRIOR)
        p = np.where(vocabulary, (pair + PAIR_PRIOR * p) / (context + PAIR_PRIOR), p)
        out.append(-np.log2(p))
    # A pair more frequent than its text is long occurs elsewhere for certain, one that occurs once does not.
    total = n[chunk.pair]
    elsewhere = total > (chunk.n + 1)[chunk.doc]
    ask = np.flatnonzero((total > 1) & ~elsewhere)
    elsewhere[ask] = total[ask] > chunk.own(chunk.pair, ask)
    scored = np.ones(len(chunk.doc), bool)
    scored[np.cumsum(chunk.n + 1) - 1] = False
    mean = lambda x: np.bincount(chunk.doc[scored], x[scored], len(chunk.n)) / np.maximum(chunk.n, 1)
    return chunk.n, mean(out[0]), mean(out[1]), mean(elsewhere.astype(float))


def lm_score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_seen: int = MIN_SEEN) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score, seen_elsewhere), a row for each row of ``docs``.

    ``target_ids``: its first column holds the ids of the target documents; all documents are the background.  Losses
    are bits a word, score is target_loss - background_loss: the lower, the more a document is like the target.  A target
    document's own words are left out of the target model that scores it, so target and other documents are judged
    alike.  seen_elsewhere: the share of its pairs of words that occur in other documents too, 1 for a copy.  A text
    that is null or without words has no token and null losses, score and share.  Repeated rows count each time; repeated
    or null target ids once or not at all.  Without a target document the target model is uniform.  Extra columns are
    ignored; an empty table gives an empty table.
    """
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("__target")).where("__target is not null").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, ranges = size // CHUNK_BYTES + 1, size // 6 // GRAMS_A_RANGE + 1
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    # The target grows with the corpus, so it is never broadcast: its ids go to the chunks that hold them.
    light = rows.select("doc_id", "chunk")
    flags = light.join(ids.hint("merge"), light.doc_id == ids["__target"]).select(F.col("chunk").alias("in_chunk"), F.col("doc_id").alias("id")).distinct()

    def read(table: pa.Table, target: np.ndarray) -> tuple[Chunk, np.ndarray]:
        chunk = Chunk(table.column("text").to_pylist())
        doc_id = table.column("doc_id")
        return chunk, np.isin(doc_id.fill_null(0).to_numpy(), target) & doc_id.is_valid().to_numpy(zero_copy_only=False)

    def occupied(keys: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Ranges that sorted ``keys`` lie in, and where those of each begin and end; work is that of the keys, however many ranges there are."""
        of = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
        return of[begin].tolist(), begin.tolist(), np.append(begin[1:], len(of)).tolist()[: len(begin)]

    def send(table: pa.Table, target: pa.Table) -> pa.Table:
        names = ["chunk", "range", "keys", "n", "t"]
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())], names)
        chunk, flag = read(table, target.column("id").to_numpy())
        n, t = chunk.counts(), chunk.counts(flag)
        some = list(zip(*occupied(chunk.keys)))
        blocks = [pa.array([planes(x[a:z]) for _, a, z in some], pa.binary()) for x in (chunk.keys, n, t)]
        return pa.Table.from_arrays([pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64()), pa.array([r for r, _, _ in some], pa.int64()), *blocks], names)

    def add(table: pa.Table) -> pa.Table:
        # One column at a time is spelt out.
        column = lambda c: [unplaned(x.as_py()) for x in table.column(c)]
        keys = column("keys")
        ends = np.cumsum([0, *map(len, keys)])
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        blocks = []
        for c in ("n", "t"):
            sums = np.bincount(which, np.concatenate(column(c)).astype(np.float64)).astype(np.uint64)[which]
            blocks.append(pa.array([planes(sums[a:z]) for a, z in zip(ends, ends[1:])], pa.binary()))
        return pa.Table.from_arrays([table.column("chunk"), table.column("range"), *blocks], ["chunk", "range", "n", "t"])

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "target_loss", "background_loss", "seen_elsewhere"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        target = told.filter(told.column("id").is_valid()).column("id").to_numpy()
        told = told.filter(told.column("range").is_valid()).sort_by("range")
        chunk, flag = read(table, target)
        n, t = (np.concatenate([unplaned(x.as_py()) for x in told.column(c)]).astype(np.int64) for c in ("n", "t"))
        cells = losses(chunk, n, t, flag, min_seen)
        none = chunk.n == 0
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(cells[0]), *(pa.array(x, mask=none) for x in cells[1:])], names)

    # One shuffle of the texts serves both sending and scoring.
    sent = rows.groupBy("chunk").cogroup(flags.groupBy("in_chunk")).applyInArrow(send, "chunk long, range long, keys binary, n binary, t binary")
    sums = sent.groupBy("range").applyInArrow(add, "chunk long, range long, n binary, t binary")
    told = sums.withColumn("id", F.lit(None).cast("long")).unionByName(flags.select(F.col("in_chunk").alias("chunk"), F.lit(None).cast("long").alias("range"), F.lit(None).cast("binary").alias("n"), F.lit(None).cast("binary").alias("t"), "id"))
    scored = rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, seen_elsewhere double")
    return scored.select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"), "seen_elsewhere")
