"""Same or near-same records across splits.

Two texts are near-same when at most one fifth of the longer text's words (characters in Chinese and Japanese) have to be
changed, dropped or added, in order. Case, punctuation, blanks and disguised characters do not count.

1. Every text becomes its unified form's words, an identity (hash of the words), and a 128-bit similarity hash: bit
   h(word) is flipped once per occurrence (an odd sketch). A changed word flips at most two bits, a dropped or added one
   one bit, so texts within d edits whose sizes differ by s lie within Hamming radius 2d - s: the radius test below is
   exact, it drops no near-same pair.
2. The text's code is segmented: a train text of n words has partners within d = n // 4 edits at most (a fifth of the longer
   text, which has at most n + d words), so of any d + 1 disjoint runs of its words one is whole in each partner. It
   selects d + 1 disjoint runs of 3 or 4 words (2 to 4 in texts of up to 11 words) that together occur least in the evaluation texts (dynamic programming over
   a count sketch of their runs); evaluation texts give all their runs. No near-same pair is dropped, whatever its length.
3. Blocks are joined across the two sides, never within one; blocks that are frequent all the same are salted. Only pairs
   within the Hamming radius leave the join, and the exact edit distance of their words decides.

Copies of a text are one class here: blocks and links are made once per class, files are expanded at the end.

Defined cases: null texts and texts without a letter or digit are never linked; a file that was exported with different
texts or splits counts with each; repeated rows count once; any split but the evaluation splits given is the train side;
empty input -> empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.textforms import unified
from corpusloom.runtime import broadcast_if_small, materialize

RUNS = (2, 3, 4)  # words of a block
SHORT = 11  # words up to which a train text has blocks of two words; longer ones have room for n // 4 + 1 blocks of three
PIECE = 256  # words whose blocks are chosen together; a multiple of 4
SKETCH_BITS = (20, 24)  # least and most; between them a slot for every SLOT runs of the evaluation texts
SLOT = 16
HOT = 20_000  # evaluation rows from which a block is salted
_SALTS = 64
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
_CACHE = 1_000_000
_MOST = 1 << 22  # counts above are all alike to the choice of runs, not to what is hot
_NEVER = 1 << 30  # above any sum of counts
_PAGE = 1 << 12  # slots that travel together


def words(text: str) -> list[str]:
    """Words of the unified form; the characters where at least a third of them are Chinese or Japanese."""
    found = _WORD.findall(_MARKS.sub("", unified(text)))
    n = sum(map(len, found))
    if n and 3 * len(_CJK.findall(text)) >= n:
        return list("".join(found))
    return found


def edits_within(a: bytes, b: bytes, limit: int) -> bool:
    """Whether the edit distance of two int32 sequences is at most ``limit`` (bit-parallel, one big integer a column)."""
    x, y = memoryview(a).cast("i").tolist(), memoryview(b).cast("i").tolist()
    # every edit takes away one word of the other text at most
    if abs(len(x) - len(y)) > limit or len(set(x).difference(y)) > limit or len(set(y).difference(x)) > limit:
        return False
    while x and y and x[-1] == y[-1]:
        x.pop()
        y.pop()
    i = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    x, y = x[i:], y[i:]
    if not x or not y:
        return max(len(x), len(y)) <= limit
    at: dict[int, int] = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    full, top, score = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    up, down = full, 0
    for w in y:
        eq = at.get(w, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp, hn = down | (full & ~(d0 | up)), d0 & up
        score += bool(hp & top) - bool(hn & top)
        hp = (hp << 1 | 1) & full
        up, down = ((hn << 1) & full) | (full & ~(d0 | hp)), hp & d0
    return score <= limit


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, text) -> file, split, identity, letters' identity, similarity hash, words as int32."""
    known: dict[str, int] = {}
    for batch in batches:
        keep, sid, glued, f1, f2, toks = [], [], [], [], [], []
        cache: dict[str, tuple] = {}
        for i, text in enumerate(batch.column(2).to_pylist()):
            if text is None:
                continue
            done = cache.get(text)
            if done is None:
                ws = words(text)
                if len(known) > _CACHE:
                    known.clear()
                hashes = []
                odd = 0
                for w in ws:
                    h = known.get(w)
                    if h is None:
                        h = known[w] = xxhash.xxh3_64_intdigest(w)
                    hashes.append(h)
                    odd ^= 1 << (h >> 57)
                arr = np.array(hashes, np.uint64)
                done = cache[text] = (
                    len(ws),
                    _signed(xxhash.xxh3_64_intdigest(" ".join(ws))),
                    _signed(xxhash.xxh3_64_intdigest("".join(ws), 1)),
                    _signed(odd & (1 << 64) - 1),
                    _signed(odd >> 64),
                    (arr & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                )
            if done[0]:
                keep.append(i)
                for to, v in zip((sid, glued, f1, f2, toks), done[1:]):
                    to.append(v)
        rows = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
        longs = [pa.array(v, pa.int64()) for v in (sid, glued, f1, f2)]
        yield pa.RecordBatch.from_arrays([*rows.columns, *longs, pa.array(toks, pa.binary())], names=["file", "split", "tid", "glued", "f1", "f2", "toks"])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _runs(toks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word counts and starts of the texts in one long array, and for each length of RUNS the hash (uint64) of the run at each word."""
    sizes = np.array([len(t) // 4 for t in toks], np.int64)
    flat = np.frombuffer(b"".join(toks), np.uint32).astype(np.uint64)
    flat = np.concatenate([flat, np.zeros(RUNS[-1], np.uint64)])
    n = len(flat) - RUNS[-1]
    h, hashes = np.zeros(n, np.uint64), []
    for k in range(RUNS[-1]):
        h = (h ^ flat[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k + 1 in RUNS:
            hashes.append(h)
    return sizes, np.cumsum(sizes) - sizes, hashes


def _all_runs(sizes: np.ndarray, starts: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs, those of two words only where a short text may be near, and the texts they stand in."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(text))  # words from here to the end of the text
    short = np.repeat(sizes <= SHORT + SHORT // 4, sizes)
    whole = [np.nonzero((left >= k) & short if k == RUNS[0] else left >= k)[0] for k in RUNS]
    return np.concatenate([h[w] for h, w in zip(hashes, whole)]), np.concatenate([text[w] for w in whole])


def _coded_counts(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, eight steps to a doubling; 0 stays 0."""
    return np.where(counts > 0, np.minimum(1 + np.round(8 * np.log2(np.maximum(counts, 1))), 255), 0).astype(np.uint8)


def _decoded_counts(codes: np.ndarray) -> np.ndarray:
    table = np.minimum(np.round(2 ** ((np.arange(256) - 1) / 8)), _MOST).astype(np.int32)
    table[0] = 0
    return table[codes]


def _chosen_runs(sizes: np.ndarray, starts: np.ndarray, hashes: list[np.ndarray], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of n // 4 + 1 disjoint runs of each text of n >= 4 words that occur least by ``seen``, and their texts.

    Runs that no evaluation text has are left out. Long texts are cut into pieces with PIECE // 4 runs each, so that the
    work grows with the length.
    """
    pieces: dict[int, list[tuple[int, int]]] = {}  # length -> (text, start); all but a text's last piece have PIECE words
    inner: list[tuple[int, int]] = []
    for i, (n, at) in enumerate(zip(sizes.tolist(), starts.tolist())):
        while n >= 2 * PIECE:
            inner.append((i, at))
            n, at = n - PIECE, at + PIECE
        if n >= 4:
            pieces.setdefault(n, []).append((i, at))
    bits = len(seen).bit_length() - 1
    groups = [(n, n // 4 + 1, found) for n, found in pieces.items()] + ([(PIECE, PIECE // 4, inner)] if inner else [])
    out, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n, wanted, found in groups:
        text, at = np.array(found, np.int64).T
        row = np.arange(len(text))
        kinds = [(k, h) for k, h in zip(RUNS, hashes) if n <= SHORT or k > RUNS[0]]
        costs = [seen[_slots(h[at[:, None] + np.arange(n - k + 1)], bits)] for k, h in kinds]
        # best[i][:, j]: least cost of i disjoint runs within the first j words
        best = [np.zeros((len(text), n + 1), np.int32)]
        for _ in range(wanted):
            next_best = np.full_like(best[0], _NEVER)
            for (k, _), cost in zip(kinds, costs):
                np.minimum(next_best[:, k:], best[-1][:, :-k] + cost, out=next_best[:, k:])
            np.minimum(next_best, _NEVER, out=next_best)
            best.append(np.minimum.accumulate(next_best, 1))
        end = np.full(len(text), n)
        for i in range(wanted, 0, -1):
            value = best[i][row, end]
            end = (best[i] > value[:, None]).sum(1)  # where the last of the i runs ends
            length, picked = np.zeros(len(text), np.int64), np.zeros(len(text), np.uint64)
            for (k, h), cost in zip(kinds, costs):
                start = np.maximum(end - k, 0)
                here = (length == 0) & (end >= k) & (best[i - 1][row, start] + cost[row, np.minimum(start, n - k)] == value)
                length[here] = k
                picked[here] = h[at + start][here]
            end = end - length
            kept = seen[_slots(picked, bits)] > 0
            out.append(picked[kept])
            texts.append(text[kept])
    return np.concatenate(out), np.concatenate(texts)


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            counts += np.bincount(_slots(_all_runs(*_runs(batch.column(0).to_pylist()))[0], bits), minlength=len(counts))
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["slot", "n"])

    return run


def _page(rows: pd.DataFrame) -> pd.DataFrame:
    codes = np.zeros(_PAGE, np.uint8)
    codes[rows["slot"].to_numpy() % _PAGE] = _coded_counts(rows["n"].to_numpy())
    return pd.DataFrame({"page": [int(rows["slot"].iloc[0]) // _PAGE], "codes": [codes.tobytes()]})


def run_counts(texts: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The count sketch of the runs of ``toks``, a byte a slot, and the hot slots: 4,096 at most, told by their full counts."""
    words = texts.agg(F.sum(F.octet_length("toks") / 4)).first()[0] or 0
    bits = min(max(int(words * len(RUNS) / SLOT).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    slots = materialize(texts.select("toks").mapInArrow(_sketch(bits), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")), "run-counts")
    mean = (slots.agg(F.sum("n")).first()[0] or 0) / (1 << bits)
    hot = [r.slot for r in slots.where(F.col("n") > max(HOT, 256 * mean)).collect()]
    codes = np.zeros(1 << bits, np.uint8)
    for r in slots.groupBy(F.floor(F.col("slot") / _PAGE)).applyInPandas(_page, "page int, codes binary").collect():
        codes[r.page * _PAGE : (r.page + 1) * _PAGE] = np.frombuffer(r.codes, np.uint8)
    return codes, hot


def _blocks(count):
    """tid, side, f1, f2, toks -> the same without toks, with the word count and the selected blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _decoded_counts(count.value)
        for batch in batches:
            sizes, starts, hashes = _runs(batch.column(4).to_pylist())
            held = batch.column(1).to_numpy() == 1
            train = np.nonzero(~held)[0]
            every, of_held = _all_runs(sizes, starts, hashes)
            every, of_held = every[held[of_held]], of_held[held[of_held]]
            chosen, of_train = _chosen_runs(sizes[train], starts[train], hashes, seen)
            text = np.concatenate([of_held, train[of_train]])
            # one number a block: its text above its key, so equal blocks of a text fall together
            both = np.unique(text.astype(np.uint64) << np.uint64(32) | np.concatenate([every, chosen]) >> np.uint64(32))
            offsets = np.searchsorted(both, np.arange(len(sizes) + 1, dtype=np.uint64) << np.uint64(32))
            values = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes.astype(np.int32)), keys], names=["tid", "side", "f1", "f2", "size", "keys"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ok = [edits_within(x, y, max(len(x), len(y)) // 4 // 5) for x, y in zip(a, b)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def coded_texts(rows: DataFrame, file: str, split: str, text: str) -> DataFrame:
    """Step 1, materialized: one row per distinct (file, split, words)."""
    coded = rows.select(F.col(file), F.col(split), F.col(text)).mapInArrow(
        _coded, "file string, split string, tid bigint, glued bigint, f1 bigint, f2 bigint, toks binary"
    )
    return materialize(coded, "coded-texts")


def linked_classes(coded: DataFrame, evaluation: list[str]) -> DataFrame:
    """Pairs ``(tid_a, tid_b)`` of a train-side and an evaluation-side class of equal texts that are near-same or equal."""
    spark = coded.sparkSession
    sided = coded.select("tid", F.col("split").isin(evaluation).cast("int").alias("side"), "glued", "f1", "f2", "toks")
    counts, hot = run_counts(sided.where("side = 1"))
    seen = spark.sparkContext.broadcast(counts)

    def blocks_of(side: int) -> DataFrame:
        rows = sided.where(F.col("side") == side).select("tid", "side", "f1", "f2", "toks")
        keyed = rows.mapInArrow(_blocks(seen), "tid bigint, side int, f1 bigint, f2 bigint, size int, keys array<int>")
        classes = keyed.groupBy("tid").agg(*[F.first(c).alias(c) for c in ("side", "f1", "f2", "size", "keys")])
        return salted(classes.select("tid", "side", "f1", "f2", "size", F.explode("keys").alias("key"))).select("key", "salt", *[F.col(c).alias(f"{c}_{'ab'[side]}") for c in ("tid", "f1", "f2", "size")])

    def salted(blocks: DataFrame) -> DataFrame:
        """Blocks in hot slots of the sketch: train rows get a salt, evaluation rows every one."""
        if not hot:
            return blocks.withColumn("salt", F.lit(0))
        slot = F.shiftrightunsigned("key", 33 - len(counts).bit_length())
        salts = F.when(slot.isin(hot), F.when(F.col("side") == 0, F.array(F.pmod("tid", F.lit(_SALTS)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        return blocks.withColumn("salt", F.explode(F.coalesce(salts, F.array(F.lit(0)))))

    a, b = blocks_of(0), blocks_of(1)
    allowed = F.floor(F.greatest("size_a", "size_b") / 5)
    apart = F.bit_count(F.col("f1_a").bitwiseXOR(F.col("f1_b"))) + F.bit_count(F.col("f2_a").bitwiseXOR(F.col("f2_b")))
    differ = F.abs(F.col("size_a") - F.col("size_b"))
    near = a.join(b, ["key", "salt"]).where((apart <= 2 * allowed - differ) & (differ <= allowed) & (F.col("tid_a") != F.col("tid_b")))
    near = materialize(near.select("tid_a", "tid_b").distinct(), "near-candidates")

    wanted = broadcast_if_small(near.select(F.col("tid_a").alias("tid")).union(near.select(F.col("tid_b"))).distinct())
    toks = sided.join(wanted, "tid", "left_semi").groupBy("tid").agg(F.first("toks").alias("toks"))
    ta, tb = toks.select(F.col("tid").alias("tid_a"), F.col("toks").alias("toks_a")), toks.select(F.col("tid").alias("tid_b"), F.col("toks").alias("toks_b"))
    verified = near.join(ta, "tid_a").join(tb, "tid_b").select("tid_a", "tid_b", "toks_a", "toks_b").mapInArrow(_verify, "tid_a bigint, tid_b bigint")

    # equal words, and equal letters where only blanks differ
    ids = sided.select("tid", "side", "glued").distinct()
    same = ids.where("side = 0").select("glued", F.col("tid").alias("tid_a")).join(ids.where("side = 1").select("glued", F.col("tid").alias("tid_b")), "glued")
    return verified.unionByName(same.select("tid_a", "tid_b")).distinct()


def overlaps(coded: DataFrame, evaluation: list[str]) -> DataFrame:
    """``(train_file, eval_file, eval_split)`` of all near-same pairs of a train-side and an evaluation-side file."""
    links = linked_classes(coded, evaluation)
    member = coded.select("file", "split", "tid").distinct()
    train = member.where(~F.col("split").isin(evaluation)).select(F.col("tid").alias("tid_a"), F.col("file").alias("train_file"))
    held = member.where(F.col("split").isin(evaluation)).select(F.col("tid").alias("tid_b"), F.col("file").alias("eval_file"), F.col("split").alias("eval_split"))
    return links.join(train, "tid_a").join(held, "tid_b").where("train_file <> eval_file").select("train_file", "eval_file", "eval_split").distinct()
