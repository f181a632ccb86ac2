"""Records of evaluation splits that stand, exactly or almost, in the training split.

Both sides are reduced to classes of equal word sequences. The evaluation
classes are cut into shards of bounded size, and each shard gets an uncompressed
full-text index over words: a suffix array by prefix doubling and the
positions of each word in the Burrows-Wheeler transform, so that one step of
backward search is one binary search. The training classes are streamed
through every shard in blocks, all texts of a block in lock step:

* From its end, each text is extended to a maximal match; the word that breaks
  it is consumed and the next match begins. A text with more than ``EDITS``
  disjoint broken stretches in a shard has no partner there and leaves at once.
* For the few texts that are left, disjoint stretches are extended until they
  are rare. Of any EDITS + 1 of them a partner holds at least one unbroken, so
  the occurrences of EDITS + 1 stretches are all candidates. If a text has no
  so many rare stretches, it is cut into EDITS + 1 equal ones, and all their
  occurrences are taken. Nothing is capped.
* A text of at most EDITS words is near every sequence of at most EDITS words;
  a longer partner shares a word with it and has at most 2 * EDITS words, so
  its candidates come from a list of the shard's short sequences by word.
* Candidates are settled by the exact word edit distance.

The spans and counts of maximal matches are merged for each training class.
Class pairs are joined back to the records of both sides.

Words: lower case, links and mentions dropped, every character that is no
letter, mark or digit dropped, split at white space; hashtags are words.

Defined results: null and blank texts, and texts without a word, have no
partner. At three edits any two texts of at most three words are a pair, by the
definition; they are all given (as pairs of classes until the last join). Copies
on either side are one class, so a third of all rows being one text costs one
search. Ties do not arise; repeated rows give no row twice; very long texts
are read whole; empty tables give no rows. The index files lie in the shared
folder; workers read them there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.session import written

EDITS = 3
#: Evaluation rows in a shard of the index; training rows in a streamed block, at most and, while cores are idle, at least.
SHARD, BLOCK, LEAST = 32_000, 40_000, 5_000
#: Occurrences below which a stretch is rare.
RARE = 8


def words_of(text: Column | str) -> Column:
    low = F.lower(text)
    dressed = low.contains("://") | low.contains("www.") | low.contains("@")
    c = F.when(dressed, F.regexp_replace(low, r"(?U)https?://\S+|www\.\S+|@\w+", " ")).otherwise(low)
    # Texts of one-byte characters only take the same cuts by plain classes.
    plain = F.octet_length(low) == F.length(low)
    any_ = F.split(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}\p{Z}\s\x{1c}-\x{1f}\x{85}]+", ""), r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+")
    ascii_ = F.split(F.regexp_replace(c, r"[^a-z0-9\s\x1c-\x1f]+", ""), r"[\s\x1c-\x1f]+")
    return F.array_remove(F.when(plain, ascii_).otherwise(any_), "")


def _classed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, c, h): the key, the digest of the words, and the words' hashes; a map without a shuffle."""
    w = df.select(F.col(key).alias("id"), words_of(text).alias("w")).where("id is not null and size(w) > 0")
    return w.select("id", F.md5(F.concat_ws(" ", "w").cast("binary")).alias("c"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


class Index:
    """Full-text index of word sequences; the sequences are separated by symbol 0."""

    FIELDS = ("alphabet", "steps", "places", "text", "starts", "names")

    def __init__(self, **fields: np.ndarray) -> None:
        for k in self.FIELDS:
            setattr(self, k, fields[k])
        self.n = len(self.text)
        self.wide = np.int64(self.n + 1)

    @classmethod
    def build(cls, names: list[str], sequences: list[np.ndarray]) -> Index:
        flat = np.concatenate([np.asarray(s, np.int64) for s in sequences])
        alphabet, ids = np.unique(flat, return_inverse=True)
        size = np.fromiter(map(len, sequences), np.int64, len(sequences))
        ends = np.cumsum(size + 1)
        starts = ends - size - 1
        text = np.zeros(int(ends[-1]) + 1, np.int32)
        text[np.arange(len(flat)) + np.repeat(np.arange(len(size)) + 0, size)] = ids.astype(np.int32) + 1
        n, rank, k = len(text), text.astype(np.int64), 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - k)] = rank[k:] + 1
            pair = rank * (int(rank.max()) + 3) + ahead
            order = np.argsort(pair, kind="stable")
            step = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = step
            if step[-1] == n - 1:
                break
            k *= 2
        before = text[order - 1].astype(np.int64)
        steps = np.sort(before * (n + 1) + np.arange(n))
        return cls(alphabet=alphabet, steps=steps, places=order.astype(np.int32), text=text, starts=starts.astype(np.int32), names=np.array(names, "S32"))

    #: Types of the fields as stored.
    KINDS = {"alphabet": "<i8", "steps": "<i8", "places": "<i4", "text": "<i4", "starts": "<i4", "names": "S32"}

    def dumps(self) -> dict[str, bytes]:
        """The fields as bytes, one column each."""
        return {k: np.ascontiguousarray(getattr(self, k), self.KINDS[k]).tobytes() for k in self.FIELDS}

    @classmethod
    def loads(cls, row: dict) -> Index:
        """From buffers of the fields, without copying them."""
        return cls(**{k: np.frombuffer(row[k], cls.KINDS[k]) for k in cls.FIELDS})

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of word hashes, -1 for words that do not occur."""
        at = np.searchsorted(self.alphabet, hashes)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == hashes, at + 1, -1).astype(np.int64)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search."""
        base = symbol * self.wide
        return np.searchsorted(self.steps, base + lo), np.searchsorted(self.steps, base + hi)

    def sequences(self, lo: int, hi: int) -> np.ndarray:
        """The sequences that hold an interval's occurrences."""
        return np.unique(np.searchsorted(self.starts, self.places[lo:hi], side="right") - 1)

    def sequence(self, i: int) -> list[int]:
        end = self.starts[i + 1] - 1 if i + 1 < len(self.starts) else self.n - 2
        return self.text[self.starts[i] : end].tolist()


def near(index: Index, flat: np.ndarray, offsets: np.ndarray, edits: int) -> np.ndarray:
    """Texts with at most ``edits`` disjoint stretches that do not occur."""
    sym = index.symbols(flat)
    at = offsets[1:] - 1
    first = offsets[:-1]
    # Every unknown word is a broken stretch of its own; most texts leave by their number.
    active = np.flatnonzero(np.add.reduceat(sym < 0, first, dtype=np.int64) <= edits)
    lo, hi = np.zeros(len(first), np.int64), np.full(len(first), index.n, np.int64)
    broken = np.zeros(len(first), np.int32)
    out = []
    while len(active):
        s = sym[at[active]]
        a, b = index.extend(np.maximum(s, 0), lo[active], hi[active])
        lost = (s < 0) | (a >= b)
        lo[active], hi[active] = np.where(lost, 0, a), np.where(lost, index.n, b)
        broken[active] += lost
        at[active] -= 1
        alive = active[broken[active] <= edits]
        done = at[alive] < first[alive]
        out.append(alive[done])
        active = alive[~done]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def matches(index: Index, sym: np.ndarray) -> tuple[int, int]:
    """Number of maximal matches of a text, from its end, and the words they cover."""
    lo, hi, spans, covered, run = 0, index.n, 0, 0, 0
    for s in sym[::-1].tolist():
        lo, hi = map(int, index.extend(np.int64(s), np.int64(lo), np.int64(hi))) if s >= 0 else (0, 0)
        if lo < hi:
            run += 1
            continue
        spans, covered, run = spans + (run > 0), covered + run, 0
        lo, hi = 0, index.n
    return spans + (run > 0), covered + run


def _candidates(index: Index, sym: np.ndarray, edits: int) -> set[int]:
    """Sequences that may be near a text of more than ``edits`` words."""
    n = len(sym)
    hits: list[tuple[int, int]] = []
    closed, lo, hi, at = 0, 0, index.n, n - 1
    while at >= 0 and closed <= edits:
        s = np.int64(sym[at])
        lo, hi = map(int, index.extend(s, np.int64(lo), np.int64(hi))) if s >= 0 else (0, 0)
        at -= 1
        if hi - lo <= RARE:
            hits.append((lo, hi))
            closed += 1
            lo, hi = 0, index.n
    if closed <= edits:
        hits = []
        cut = [n * i // (edits + 1) for i in range(edits + 2)]
        for a, b in zip(cut, cut[1:]):
            lo, hi = 0, index.n
            for s in sym[a:b][::-1]:
                if s < 0:
                    lo = hi = 0
                    break
                lo, hi = map(int, index.extend(np.int64(s), np.int64(lo), np.int64(hi)))
                if lo >= hi:
                    break
            hits.append((lo, hi))
    found: set[int] = set()
    for lo, hi in hits:
        if hi > lo:
            found.update(index.sequences(lo, hi).tolist())
    return found


class Brief:
    """The short sequences of an index: all of at most ``edits`` words, and those of up to twice as many by word."""

    def __init__(self, index: Index, edits: int) -> None:
        size = np.diff(np.append(index.starts, index.n - 1)) - 1
        self.least = np.flatnonzero(size <= edits).tolist()
        self.by: dict[int, list[int]] = {}
        for e in np.flatnonzero((size > edits) & (size <= 2 * edits)).tolist():
            for s in set(index.sequence(e)):
                self.by.setdefault(s, []).append(e)

    def candidates(self, sym: np.ndarray) -> set[int]:
        return set(self.least).union(*[self.by.get(s, ()) for s in sym.tolist()])


def distance(a: list[int], b: list[int], most: int) -> int:
    """Word edit distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(a) - i and j < len(b) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    row = {k: k for k in range(min(len(b), most) + 1)}
    for x in range(1, len(a) + 1):
        new = {}
        for y in range(max(0, x - most), min(len(b), x + most) + 1):
            v = row.get(y, most + 1) + 1
            if y:
                v = min(v, new.get(y - 1, most + 1) + 1, row.get(y - 1, most + 1) + (a[x - 1] != b[y - 1]))
            else:
                v = x
            new[y] = v
        row = new
        if min(row.values()) > most:
            return most + 1
    return min(most + 1, row.get(len(b), most + 1))


def search(index: Index, flat: np.ndarray, offsets: np.ndarray, edits: int) -> list[tuple[int, bytes, int, int, int]]:
    """(text, name of the sequence, distance, spans, covered words) of every near pair."""
    out = []
    brief = None
    for i in near(index, flat, offsets.copy(), edits).tolist():
        sym = index.symbols(flat[offsets[i] : offsets[i + 1]])
        if len(sym) <= edits:
            brief = brief or Brief(index, edits)
            found = brief.candidates(sym)
        else:
            found = _candidates(index, sym, edits)
        mine = sym.tolist()
        near_ = [(e, d) for e in sorted(found) if (d := distance(mine, index.sequence(e), edits)) <= edits]
        if near_:
            spans, covered = matches(index, sym)
            out += [(i, index.names[e], d, spans, covered) for e, d in near_]
    return out


def near_classes(train: DataFrame, evaluation: DataFrame, edits: int = EDITS) -> DataFrame:
    """(t, e, distance, spans, covered) of all near pairs of classes; inputs are (id, c, h) as of ``_classed``."""
    ev = evaluation.select("c", "h").dropDuplicates(["c"])
    tr = train.select("c", "h").dropDuplicates(["c"])
    # Rows bound the classes from above; both inputs are written tables, so these counts read no column.
    shards = max(1, -(-evaluation.count() // SHARD))
    rows, cores = train.count(), train.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-rows // BLOCK), min(cores, rows // LEAST))

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("c")
        index = Index.build(pdf["c"].tolist(), pdf["h"].tolist())
        return pd.DataFrame({k: [v] for k, v in index.dumps().items()})

    sharded = ev.withColumn("shard", F.pmod(F.xxhash64("c"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    held = written(sharded.groupBy("shard").applyInPandas(build, ", ".join(f"{k} binary" for k in Index.FIELDS)), "index")
    place = sorted(f for f in held.inputFiles())
    names = "t string, e string, distance int, spans int, covered int"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        keys: list[str] = []
        parts: list[np.ndarray] = []
        for b in batches:
            keys += b["c"].tolist()
            parts += b["h"].tolist()
        if not keys:
            return
        flat = np.concatenate(parts)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        for uri in place:
            where, path = fs.FileSystem.from_uri(uri)
            with where.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=1, columns=list(Index.FIELDS)):
                    for i in range(batch.num_rows):
                        index = Index.loads({k: batch.column(k)[i].as_buffer() for k in Index.FIELDS})
                        rows = [(keys[j], e.decode(), d, s, n) for j, e, d, s, n in search(index, flat, offsets, edits)]
                        if rows:
                            yield pd.DataFrame(rows, columns=["t", "e", "distance", "spans", "covered"])

    return tr.repartition(blocks, "c").mapInPandas(run, names)


def overlaps(train: DataFrame, evaluation: DataFrame, train_key: str = "qid", eval_key: str = "qid", text: str = "text", edits: int = EDITS) -> DataFrame:
    """(train_id, eval_id, distance, spans, covered) of every near pair of records; no row twice.

    Each text is cut into words once; the keys of both sides that have no pair leave before anything of them is shuffled.
    """
    a, b = written(_classed(train, train_key, text), "train"), written(_classed(evaluation, eval_key, text), "eval")
    pairs = written(near_classes(a, b, edits), "pairs")

    def records(side: DataFrame, name: str, c: str) -> DataFrame:
        r = side.select(F.col("id").alias(name), F.col("c").alias(c))
        return r.join(pairs.select(c).distinct(), c, "left_semi").distinct()

    joined = pairs.join(records(a, "train_id", "t"), "t").join(records(b, "eval_id", "e"), "e")
    return joined.select("train_id", "eval_id", "distance", "spans", "covered").distinct()
