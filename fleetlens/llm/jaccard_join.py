"""Exact Jaccard self-join of word n-gram sets by universe partition.

Two sets of sizes r and s with similarity at least t differ in at most
H = floor((r + s)(1 - t)/(1 + t)) tokens.  Sizes are cut into bands, and for each
band tokens are hashed into segments, of which there are enough that H
differences cannot touch them all:

- a plain segment stands for one difference: sets that agree on it share the
  signature of their segment subset;
- a one-deletion segment stands for two: a set also gives the signature of its
  subset without each single token, so subsets that differ in one token meet.

How many segments of a band are of which kind is decided by cost: signature rows
against expected false candidates, from the histogram of (estimated) sizes of all
documents.  There are more plain segments than needed; a set of size n keeps its
H(n) + 1 fullest ones, full subsets being rare ones.  Subsets that agree rank alike in
both sets, so the fullest segment on which two similar sets agree is kept by both,
and no pair is lost.  A set joins its own band and, if it may link to sets above it,
the next.

Sets are 64-bit hashes of the n-grams.  Documents with equal sets form one class,
represented by the smallest id.  Sets that share a signature are compared and joined
by ``linking``: a group of near copies costs a number of comparisons linear in its
size, and still every pair that could join two components is decided.

Defined cases: a NULL text or one without words has the empty set and links to
nothing; rows with a NULL doc_id have no component (NULL) and link to nothing;
repeated rows are one class; classes whose smallest id is the same (an id repeated
with different texts) count as linked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import doc_texts, free_name, map_arrow, materialise, quoted, release, stored
from fleetlens.llm.linking import SEEDS, Threshold, class_sets, classes_of, find_components, label, leader_pairs, mix, set_key

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Texts whose signatures are held at once.
SLICE = 500
_CACHE_WORDS = 100_000

SMALLEST_BAND = 8
BAND_RATIO = 1.5
SPARE_SEGMENTS = 1.15
#: Cost model: chance that a token of a kept (full) segment is in an unrelated set too, comparisons against rows.
SHARED_TOKEN = 0.01
PAIR_COST = 20.0
BYTES_PER_TOKEN = 6.3
#: Ids up to this many (16 MB of longs) may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the word n-grams (A-Z lower-cased, words between
    white space); a shorter text is one n-gram."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    cache = stored("words", "hashes", dict)
    if len(cache) > _CACHE_WORDS:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(width, len(h))))
    for i in range(min(width, len(h))):
        out = mix(out * SEEDS[0] + h[i:i + n])
    return np.unique(out)


@dataclass(frozen=True)
class Band:
    number: int
    low: int     # sizes low < n <= high
    high: int
    deleting: int  # one-deletion segments, twice as wide
    plain: int


class Scheme:
    """The bands and their segments for a threshold num / den."""

    def __init__(self, num: int, den: int, bands: list[Band]):
        self.num, self.den, self.bands = num, den, bands
        self.highs = np.array([b.high for b in bands])

    def differences(self, total: int) -> int:
        return total * (self.den - self.num) // (self.den + self.num)

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if not n:
            return np.empty(0, np.uint64)
        largest = n * self.den // self.num
        own = int(np.searchsorted(self.highs, n))
        found = [self._in_band(tokens, self.bands[own], largest)]
        if largest > self.bands[own].high and own + 1 < len(self.bands):
            found.append(self._in_band(tokens, self.bands[own + 1], largest))
        return np.concatenate(found)

    def _in_band(self, tokens: np.ndarray, band: Band, largest: int) -> np.ndarray:
        need = self.differences(len(tokens) + min(largest, band.high)) + 1
        if need == 1:
            return np.empty(0, np.uint64)  # only equal sets, which are one class
        salt = np.uint64((band.number + 1) * int(SEEDS[1]) % 2 ** 64)
        width = np.uint64(2 * band.deleting + band.plain)
        place = (mix(tokens ^ salt) >> np.uint64(32)) * width >> np.uint64(32)
        double = np.uint64(2 * band.deleting)
        at = np.where(place < double, place >> np.uint64(1), place - double + np.uint64(band.deleting)).astype(np.int64)
        weight = mix(tokens + SEEDS[2])
        total = np.zeros(band.deleting + band.plain, np.uint64)
        np.add.at(total, at, weight)
        name = (np.arange(len(total)).astype(np.uint64) + np.uint64(1)) * SEEDS[3] ^ salt
        out = []
        used = min(band.deleting, -(-need // 2))
        if used:
            mine = at < used
            out += [mix(total[:used] + name[:used]), mix(total[at[mine]] - weight[mine] + name[at[mine]])]
        rest = need - 2 * band.deleting
        if rest > 0:
            plain = mix(total[band.deleting:] + name[band.deleting:])
            count = np.bincount(at, minlength=len(total))[band.deleting:]
            out.append(plain[np.lexsort((plain, count))[-rest:]])
        return np.concatenate(out)


def allocate(num: int, den: int, sizes: dict[int, int]) -> Scheme:
    """Bands up to beyond the largest size, and for each the cheapest split of
    the needed differences over plain and one-deletion segments.

    ``sizes`` counts documents by (estimated) set size; it moves cost only.
    """
    ratio = max(BAND_RATIO, 1.01 * den / num)
    bands, low, high = [], 0, SMALLEST_BAND
    top = 2 ** 31
    scheme = Scheme(num, den, [])
    while low < top:
        n_sets = sum(c for s, c in sizes.items() if low < s <= high)
        need = scheme.differences(2 * high) + 1
        bands.append(Band(len(bands), low, high, *_cheapest(need, (low + high) / 2, n_sets)))
        low, high = high, int(high * ratio) + 1
    return Scheme(num, den, bands)


def _cheapest(need: int, size: float, n_sets: int) -> tuple[int, int]:
    best = None
    most = -(-need // 2)
    for deleting in sorted({*range(min(most, 16) + 1), *np.linspace(0, most, 17).astype(int).tolist()}):
        rest = max(0, need - 2 * deleting)
        plain = int(rest * SPARE_SEGMENTS) + 1 if rest else 0
        tokens = size / (2 * deleting + plain)
        rows = n_sets * (deleting * (1 + 2 * tokens) + rest)
        pairs = n_sets ** 2 / 2 * (deleting * (1 + 2 * tokens) * SHARED_TOKEN ** max(0.0, 2 * tokens - 1) + rest * SHARED_TOKEN ** tokens)
        cost = rows + PAIR_COST * pairs
        if best is None or cost < best[0]:
            best = cost, deleting, plain
    return best[1], best[2]


def _profiles(texts: DataFrame, width: int, scheme: Scheme) -> DataFrame:
    """doc_id, n, k1, k2 (128-bit hash of the set) and the signatures; of equal
    sets in one batch only the first carries signatures."""
    shared = texts.sparkSession.sparkContext.broadcast(scheme)

    def run(batches):
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            ids, rows, sigs, seen = b.column(0), [], [], set()
            for known, text in zip(ids.is_valid().to_pylist(), b.column(1).to_pylist(), strict=True):
                t = shingle_set(text, width)
                key = set_key(t)
                rows.append(key)
                if not known or key in seen or not len(t):
                    sigs.append(np.empty(0, np.uint64))
                else:
                    seen.add(key)
                    sigs.append(shared.value.signatures(t))
            k = np.array(rows, np.uint64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            flat = np.concatenate([*sigs, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(k[:, 2].astype(np.int64)), pa.array(k[:, 0].view(np.int64)), pa.array(k[:, 1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n", "k1", "k2", "sigs"])

    return materialise(map_arrow(texts, run, "doc_id long, n long, k1 long, k2 long, sigs array<long>", "words"), "profiles")


def near_duplicates(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, for links
    den * |intersection| >= num * |union|."""
    texts = doc_texts(docs)
    step = F.floor(F.log2(F.octet_length("text") / BYTES_PER_TOKEN + 1) * 8)
    hist = texts.where("text is not null").groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()  # at most 8 rows an octave
    scheme = allocate(num, den, {max(1, int(2 ** (r["s"] / 8))): r["n"] for r in hist})
    profiles = _profiles(texts, width, scheme)
    classes = classes_of(profiles)
    pairs = leader_pairs(profiles, classes)
    sets = class_sets(texts, pairs, classes, lambda text: shingle_set(text, width))
    how = Threshold(num, den)
    found = find_components(pairs, sets, classes, how, plausible=lambda p: p.where(how.alike("n_a", "n_b")))
    release(pairs, sets)
    return label(profiles, classes, found)


def _few(ids: DataFrame) -> bool:
    """Whether a materialised id list is small enough to broadcast."""
    return ids.count() <= BROADCAST_IDS


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    return _orderable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType))


def keep_one_per_component(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (all columns) without those whose component has a
    smaller id; of several rows of one id the smallest stays (columns without an
    order, such as maps, do not count).  Rows with a NULL id stay."""
    grouped = materialise(near_duplicates(docs, **how), "grouped")
    name, row = free_name(docs.columns, "gone"), free_name(docs.columns, "row")
    gone = materialise(grouped.where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    key = F.col("doc_id").cast("long") == F.col(name)
    kept = docs.join(F.broadcast(gone) if _few(gone) else gone, key, "left_anti")
    if grouped.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept
    every = quoted(docs.columns)
    order = [q for q, f in zip(every, docs.schema.fields, strict=True) if _orderable(f.dataType)]
    # A grouped minimum, so copies of one id are reduced before the shuffle.
    one = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*every), F.struct(*order)).alias(row))
    return one.select(f"{row}.*").unionByName(kept.where("doc_id is null"))
