"""Near-duplicate texts over word shingles: an inverted index on (position, bytes), count filtering, then verification.

The shingles of a text are ordered from rare to frequent by one order for the whole corpus. If two texts reach the
similarity, the first ``n - ceil(t n) + l`` places of both hold at least ``l`` common shingles: only those places are
indexed, each under its shingle and with its position. The shared ones of a pair are tallied; what the tally and the
places after the last shared one could still amount to must reach the overlap that the similarity asks for, and so
must the bound that the bytes of two parity bitmaps give. The pairs left are verified on the whole sets. No pair that
reaches the similarity can be lost.

A key of the index is the eight hash bytes of a shingle, not a single byte: the list of a one-byte key would hold a
256th of the corpus, and its pairs would grow with the square of the corpus.

The key space is cut into parts by the size of the index. A task goes through its parts one after another and holds one
at a time, so what it holds does not grow with the corpus. The list of a frequent key is cut into blocks by its length,
and every two blocks meet in a cell of their own, which falls into a part like any key.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, small_enough
from .components import components

#: Counters of the sketch of shingle frequencies. A byte each, 8 MiB in all, whatever the corpus: all that is ever sent to the
#: driver and to the tasks. A fuller sketch orders less sharply, nothing else.
SKETCH_BITS = 23
SEGMENT_BITS = 17
MATCHES = 2
#: 64-bit words of a parity bitmap: the bits in which two of them differ are a lower bound of the shingles in which the sets differ.
WORDS = 8
#: Postings of a part of the key space, by which the parts are numbered: what a task holds at a time.
PART = 1 << 20
#: Postings of one key that are compared with each other in one place; longer lists are cut into blocks.
BLOCK = 1 << 15
#: Postings packed into a row at most.
PACKED = 1 << 20
#: Members of a class that are expanded into pairs in one place.
HOT = 1 << 12
#: Tasks at most that parts are dealt to; beyond that a task goes through several.
MAX_TASKS = 1 << 16
#: Texts hashed at a time: their number within the slice has to fit the upper bits of a sort key.
SLICE = 1 << 13


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in order, and the text each belongs to."""
    words = [t.lower().split() if t else [] for t in texts]
    flat = list(chain.from_iterable(words))
    m = len(flat) - k + 1
    if m < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ids = {w: xxhash.xxh3_64_intdigest(w) for w in set(flat)}
    w = np.fromiter(map(ids.__getitem__, flat), np.uint64, len(flat))
    doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, words), np.int64, len(words)))
    h = w[:m].copy()
    for i in range(1, k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (h >> np.uint64(29)) + w[i : i + m]
    whole = doc[:m] == doc[k - 1 :]
    return _mix(h[whole]), doc[:m][whole]


def shingle_sets(texts: list[str | None], k: int, grade_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, text after text and within each by grade and hash; the text and the grade of each."""
    out = []
    for at in range(0, len(texts), SLICE):
        h, doc = _shingles(texts[at : at + SLICE], k)
        grade = np.zeros(len(h), np.uint8) if grade_of is None else grade_of[(h & np.uint64(len(grade_of) - 1)).astype(np.int64)]
        order = np.argsort((doc.astype(np.uint64) << np.uint64(51)) | (grade.astype(np.uint64) << np.uint64(43)) | (h >> np.uint64(21)))
        h, doc, grade = h[order], doc[order], grade[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        out.append((h[first], doc[first] + at, grade[first]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8))


def _grade(count: np.ndarray) -> np.ndarray:
    """A count on a logarithmic scale of one byte, rounded up."""
    return np.minimum(255, np.ceil(4 * np.log2(1.0 + count))).astype(np.uint8)


def _sketch(docs: DataFrame, text: str, k: int) -> list[bytes]:
    """The grade of each counter over the shingles of all texts, in segments; of one size whatever the corpus.

    A task adds up all its texts before it sends anything on; the sums of many tasks meet in groups first, then all together,
    each segment on its own, so no task reads more than the root of the number of tasks times a segment."""
    segments, part = 1 << (SKETCH_BITS - SEGMENT_BITS), 1 << SEGMENT_BITS
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    schema = "seg int, grp int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            h, _ = _shingles(b.column(0).to_pylist(), k)
            if len(h):
                total = np.zeros(1 << SKETCH_BITS, np.uint32) if total is None else total
                np.add.at(total, (h & mask).astype(np.int64), np.uint32(1))
        if total is not None:
            from pyspark import TaskContext

            group = TaskContext.get().partitionId()
            for i in range(segments):
                raw = total[i * part : (i + 1) * part].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([group], pa.int32()), pa.array([zlib.compress(raw, 1)], pa.binary())], ["seg", "grp", "counts"])

    def add(kind: type, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for seg, counts in zip(b.column(0).to_pylist(), b.column(2)):
                    own = np.frombuffer(zlib.decompress(counts.as_py()), kind)
                    sums[seg] = sums[seg] + own if seg in sums else own.astype(np.uint64)
            for seg, total in sums.items():
                raw = (_grade(total) if last else total).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(raw, 6 if last else 1)], pa.binary())], ["seg", "grp", "counts"])

        return run

    texts = docs.select(text)
    sums = texts.mapInArrow(count, schema)
    tasks = texts.rdd.getNumPartitions()
    kind = np.uint32
    if tasks > segments:
        groups, kind = round(tasks**0.5), np.uint64
        sums = sums.withColumn("grp", F.col("grp") % groups).repartition(segments * groups, "seg", "grp").mapInArrow(add(np.uint32, False), schema)
    last = max(1, min(segments, tasks))
    got = {r.seg: bytes(r.counts) for r in sums.repartitionById(last, F.col("seg") % last).mapInArrow(add(kind, True), schema).collect()}
    empty = zlib.compress(bytes(part), 1)
    return [got.get(i, empty) for i in range(segments)]


def _table(sketch: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in sketch])


def _prefixes(docs: DataFrame, id_: str, text: str, k: int, t: float, grades) -> DataFrame:
    """(id, fp, n, bitmap, keys, places): the fingerprint and size of the shingle set and what is to be indexed. Texts of under k words
    give no row. A key that occurs once in the corpus (the sketch never counts too few) cannot be shared and is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade_of = _table(grades.value)
        for b in batches:
            h, doc, grade = shingle_sets(b.column(1).to_pylist(), k, grade_of)
            if not len(h):
                continue
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            n = np.diff(np.r_[starts, len(doc)])
            fp = (np.add.reduceat(_mix(h ^ np.uint64(0xA0761D6478BD642F)), starts)).view(np.int64)
            place = np.arange(len(doc)) - np.repeat(starts, n)
            keep = (place < np.repeat(_length(n, t), n)) & (grade > 4)
            bits = np.zeros(len(starts) * WORDS, np.uint64)
            at = (h >> np.uint64(13)) % np.uint64(64 * WORDS)
            np.bitwise_xor.at(bits, np.repeat(np.arange(len(starts)) * WORDS, n) + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            bitmap = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS), len(starts), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
            offsets = pa.array(np.r_[0, np.cumsum(np.add.reduceat(keep.astype(np.int64), starts))].astype(np.int32))
            keys = pa.ListArray.from_arrays(offsets, pa.array(h[keep].view(np.int64)))
            places = pa.ListArray.from_arrays(offsets, pa.array(place[keep].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[starts])), pa.array(fp), pa.array(n.astype(np.int32)), bitmap, keys, places], ["id", "fp", "n", "bitmap", "keys", "places"])

    kind = docs.schema[id_].dataType.simpleString()
    return docs.select(F.col(id_).alias("id"), text).mapInArrow(run, f"id {kind}, fp long, n int, bitmap binary, keys array<long>, places array<int>")


def _length(n: np.ndarray, t: float) -> np.ndarray:
    """Places that are indexed of a set of n."""
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + MATCHES


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(fp, items) of (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, doc, _ = shingle_sets(b.column(1).to_pylist(), k)
            offsets = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))], ["fp", "items"])

    return docs.mapInArrow(run, "fp long, items array<long>")


def _cells(key: np.ndarray, fp: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where postings go: (row of the posting, key of the cell, side). A list of one block is a cell of its own, side 0. A posting of a longer
    one goes to its block's own cell and to one cell for each other block, where it is on the side of the lower or the higher block."""
    row = np.repeat(np.arange(len(key)), blocks)
    other = (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)).astype(np.uint64)
    many = blocks[row] > 1
    own = _mix(fp.view(np.uint64)[row] ^ np.uint64(0x2545F4914F6CDD1D)) % blocks.astype(np.uint64)[row]
    low, high = np.minimum(own, other), np.maximum(own, other)
    cell = np.where(many, _mix(key.view(np.uint64)[row] ^ _mix((low << np.uint64(32)) | high | np.uint64(1 << 63))), key.view(np.uint64)[row])
    return row, cell, np.where(many & (own != other), np.where(own < other, 1, 2), 0).astype(np.int32)


def _pack(fp: np.ndarray, n: np.ndarray, bits: np.ndarray, sizes: np.ndarray, keys: np.ndarray, places: np.ndarray) -> bytes:
    """Sets with their postings as one string of bytes; of a posting ten bytes or so are left."""
    small = zlib.compress(b"".join(x.astype(np.int32).tobytes() for x in (n, sizes, places)), 1)
    return struct.pack("<III", len(fp), len(keys), len(small)) + small + fp.tobytes() + bits.tobytes() + keys.tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    m, p, length = struct.unpack_from("<III", raw)
    small = np.frombuffer(zlib.decompress(raw[12 : 12 + length]), np.int32)
    rest = np.frombuffer(raw, np.uint8, offset=12 + length).tobytes()  # aligned again
    words = np.frombuffer(rest, np.uint64)
    return words[:m].view(np.int64), small[:m], words[m : m + m * WORDS].reshape(m, WORDS), small[m : 2 * m], words[m + m * WORDS :], small[2 * m :]


def _postings(index: DataFrame, parts: int, grades, block: int) -> DataFrame:
    """(part, packed): the postings of many sets by part of the key space, size and bitmap of a set once for all its postings there.
    Places hold the side in their lowest two bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade_of = _table(grades.value)
        for b in batches:
            fp, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            bits = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, WORDS)
            flat, place = b.column(3).flatten().to_numpy(zero_copy_only=False), b.column(4).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(3).offsets.to_numpy()))
            for c in range(0, len(flat), PACKED):
                key, own = flat[c : c + PACKED], row[c : c + PACKED]
                # the longest the list can be, by the sketch
                most = np.exp2(grade_of[(key.view(np.uint64) & np.uint64(len(grade_of) - 1)).astype(np.int64)] / 4)
                at, cell, side = _cells(key, fp[own], np.maximum(1, np.ceil(most / block)).astype(np.int64))
                own, seat = own[at], place[c : c + PACKED][at] * 4 + side
                part = (cell % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((own, part))
                own, seat, cell, part = own[order], seat[order], cell[order], part[order]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                packed = []
                for x, y in zip(cuts, np.r_[cuts[1:], len(part)]):
                    sets, sizes = np.unique(own[x:y], return_counts=True)
                    packed.append(_pack(fp[sets], n[sets], bits[sets], sizes, cell[x:y], seat[x:y]))
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(packed, pa.binary())], ["part", "packed"])

    return index.select("fp", "n", "bitmap", "keys", "places").mapInArrow(run, "part int, packed binary")


def _needed(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    return np.ceil((na + nb) * (t / (1 + t)) - 1e-9)


def _near(i: np.ndarray, j: np.ndarray, pi: np.ndarray, pj: np.ndarray, fp: np.ndarray, n: np.ndarray, bits: np.ndarray, t: float) -> np.ndarray:
    """Which pairs of rows may reach the similarity, by their sizes, the places of the shingle they share (what both have before it
    and after it bounds the overlap) and their bitmaps."""
    na, nb = n[i], n[j]
    keep = (fp[i] != fp[j]) & (np.minimum(na, nb) >= np.maximum(na, nb) * t - 1e-9)
    keep &= np.minimum(pi, pj) + np.minimum(na - pi, nb - pj) >= _needed(na, nb, t)
    i, j, na, nb = i[keep], j[keep], na[keep], nb[keep]
    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
    keep[keep] = (na + nb - apart) // 2 >= _needed(na, nb, t)
    return keep


def _expand(t: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of the postings of each part: (a, b, at_a, at_b), ``at`` holding the size and the place. One part is held at a time."""

    def part_pairs(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        fp, n, bits, sizes, key, place = (np.concatenate(x) for x in zip(*map(_unpack, held)))
        n, place = n.astype(np.int64), place.astype(np.int64)
        row = np.repeat(np.arange(len(fp)), sizes)
        order = np.lexsort((fp[row], key))
        key, place, row = key[order], place[order], row[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (fp[row[1:]] != fp[row[:-1]])]  # copies of a set are one
        key, place, row = key[once], place[once], row[once]
        place, side = place >> 2, place & 3
        at = n[row] * (1 << 31) + place
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        length = ends - starts

        def pairs(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            ok = ((side[i] == 0) & (side[j] == 0)) | (side[i] != side[j])
            i, j = i[ok], j[ok]
            ok = _near(row[i], row[j], place[i], place[j], fp, n, bits, t)
            i, j = i[ok], j[ok]
            a, b = fp[row[i]], fp[row[j]]
            x, y = np.where(a < b, i, j), np.where(a < b, j, i)
            return pa.RecordBatch.from_arrays([pa.array(fp[row[x]]), pa.array(fp[row[y]]), pa.array(at[x]), pa.array(at[y])], ["a", "b", "at_a", "at_b"])

        for d in range(1, int(length.max())):  # the d-th neighbour within a list
            long_enough = length > d
            i = np.concatenate([np.arange(s, e - d) for s, e in zip(starts[long_enough], ends[long_enough])]) if long_enough.sum() < 64 else np.flatnonzero(np.arange(len(key)) + d < np.repeat(ends, length))
            for c in range(0, len(i), 1 << 20):
                yield pairs(i[c : c + (1 << 20)], i[c : c + (1 << 20)] + d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        current = None
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1)):
                if held and part != current:
                    yield from part_pairs(held)
                    held = []
                current = part
                held.append(packed.as_py())
        if held:
            yield from part_pairs(held)

    return run


def class_pairs(docs: DataFrame, id_: str, text: str, k: int = 5, t: float = 0.8, part: int = PART, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Membership (id, fp), ``fp`` being the class of texts with one shingle set, and the pairs (a, b, similarity) of classes, a < b, whose
    Jaccard similarity is ``t`` or more.

    Words are the lower-cased pieces between white space; shingles are ``k`` of them. Null texts and texts of under ``k`` words are
    in no class. Rows with one id and several texts count as several texts. Classes are told apart by a 64-bit sum of mixed hashes.
    """
    docs = docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    grades = docs.sparkSession.sparkContext.broadcast(_sketch(docs, "text", k))
    index = materialise(_prefixes(docs, "id", "text", k, t, grades))
    members = index.select("id", "fp")
    # as many parts as hold all places that could be indexed; each is a shuffle partition
    places = index.agg(F.sum(F.col("n") - F.ceil(F.col("n") * t) + MATCHES)).first()[0] or 1
    parts = max(1, -(-int(places) // part))
    dealt = _postings(index, parts, grades, block).repartitionById(min(parts, MAX_TASKS), F.col("part") % min(parts, MAX_TASKS))
    dealt = dealt.sortWithinPartitions("part") if parts > MAX_TASKS else dealt
    pairs = dealt.mapInArrow(_expand(t), "a long, b long, at_a long, at_b long")
    tally = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("at_a").alias("pa"), F.max("at_b").alias("pb"))
    # n and place travel in one long: the largest of a pair's rows tells n and its last shared place
    na, nb = F.floor(F.col("pa") / (1 << 31)), F.floor(F.col("pb") / (1 << 31))
    needed = F.ceil((na + nb) * (t / (1 + t)) - 1e-9)
    after = F.least(na - F.col("pa") % (1 << 31), nb - F.col("pb") % (1 << 31)) - 1
    outside = F.greatest(F.ceil(na * t - 1e-9), F.ceil(nb * t - 1e-9)) - MATCHES
    possible = F.col("shared") + F.greatest(F.lit(0), F.least(after, outside))
    pairs = materialise(tally.filter((possible >= needed) & (F.col("shared") >= F.least(F.lit(MATCHES), needed))).select("a", "b"))
    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("fp")
    reps = materialise(members.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("id")))
    # rows that share an id but not the text give sets of other fingerprints too; those of the wanted class are kept
    texts = docs.join(small_enough(reps), "id").select("fp", "text").distinct()
    sets = _sets(texts, k)
    left, right = sets.toDF("a", "ia"), sets.toDF("b", "ib")
    both = F.size(F.array_intersect("ia", "ib"))
    checked = pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("ia") + F.size("ib") - both)).alias("similarity"))
    return members, checked.filter(F.col("similarity") >= t - 1e-12).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def pairs(docs: DataFrame, id_: str, text: str, k: int = 5, t: float = 0.8, part: int = PART, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(id_a, id_b), a < b, of all texts whose similarity is ``t`` or more, copies included."""
    members, links = class_pairs(docs, id_, text, k, t, part, block)
    members, links = materialise(members.distinct()), materialise(links.select("a", "b"))
    # the members of a class fall into shares of about ``hot``, so that a large class is expanded by many tasks
    size = members.groupBy("fp").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("shares"))
    size = size.filter("shares > 1")
    if size.isEmpty():
        a, b = members.toDF("x", "a"), members.toDF("y", "b")
        across = links.join(a, "a").join(b, "b").select("x", "y")
        within = a.join(b, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    else:
        share = F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1))).cast("int")
        dealt = materialise(members.join(size, "fp", "left").select("id", "fp", share.alias("share"), F.coalesce("shares", F.lit(1)).alias("shares")))
        size = size.toDF("fp", "shares")
        each = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
        a, b = dealt.select(F.col("id").alias("x"), F.col("fp").alias("a"), F.col("share").alias("sa")), dealt.select(F.col("id").alias("y"), F.col("fp").alias("b"), F.col("share").alias("sb"))
        of = lambda c: F.coalesce(c, F.lit(1))
        cells = links.join(size.toDF("a", "na"), "a", "left").join(size.toDF("b", "nb"), "b", "left")
        cells = cells.withColumn("sa", each(of(F.col("na")))).withColumn("sb", each(of(F.col("nb")))).select("a", "b", "sa", "sb")
        across = cells.join(a, ["a", "sa"]).join(b, ["b", "sb"]).select("x", "y")
        spread = dealt.select(F.col("id").alias("y"), F.col("fp").alias("a"), each(F.col("shares")).alias("sa"))
        within = a.join(spread, ["a", "sa"]).filter("x < y").select("x", "y")
    return across.union(within).filter("x <> y").select(F.least("x", "y").alias(f"{id_}_a"), F.greatest("x", "y").alias(f"{id_}_b")).distinct()


def groups(docs: DataFrame, id_: str, text: str, k: int = 5, t: float = 0.8) -> DataFrame:
    """(id, class_id, group_id, links) of every text with shingles: its class of equal sets, its group over chains of similar texts
    and the number of other classes it is similar to. Copies are not expanded into pairs."""
    members, links = class_pairs(docs, id_, text, k, t)
    links = materialise(links)
    roots = components(links, "a", "b").toDF("fp", "root")
    degree = links.select("a").union(links.select("b")).toDF("fp").groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    out = members.distinct().join(roots, "fp", "left").join(degree, "fp", "left")
    return out.select(F.col("id").alias(id_), F.col("fp").alias("class_id"), F.coalesce("root", "fp").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _without_shingles(docs: DataFrame, k: int) -> DataFrame:
    """(id, class_id) of the (id, text) that have no shingle: the hash of the whole word list, null texts being a class of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, classes = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t is None or len(t.split(None, k - 1)) < k:
                    at.append(i)
                    classes.append(xxhash.xxh3_64_intdigest("null" if t is None else "words " + " ".join(t.lower().split()), seed=k))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(np.array(classes, np.uint64).view(np.int64))], ["id", "class_id"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, class_id long")


def document_groups(docs: DataFrame, id_: str, text: str, k: int = 5, t: float = 0.8) -> DataFrame:
    """``groups`` with a row for every document: texts without shingles (null, empty, under ``k`` words) are in one class and group with
    those of the same words in the same order, and similar to no other class."""
    short = _without_shingles(docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")), k).distinct()
    rest = short.select(F.col("id").alias(id_), "class_id", F.col("class_id").alias("group_id"), F.lit(0).cast("long").alias("links"))
    return groups(docs, id_, text, k, t).unionByName(rest)
