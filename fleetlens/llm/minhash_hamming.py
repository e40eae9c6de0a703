"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's word n-gram set gives ``SYMBOLS`` minima of independent hash
functions, each cut to 16 bits.  Two sets of similarity t differ in a symbol with
probability of at most 1 - t, so all but a share MISS of the pairs at the threshold
(fewer above it) differ in at most ``distance`` symbols.

All pairs within that distance are found, by pigeonhole: the signature is cut into
distance // 2 + 1 chunks, so two signatures within the distance differ in at most
one symbol of some chunk.  That error is enumerated by its place: each chunk gives
one key for each of its symbols, made of the other symbols, and two chunks that
differ in one symbol at most share such a key.

Signatures that share a key are joined by ``linking``: pairs beyond the distance
are left out, the others are confirmed on the full sets, and a hot key (a group of
near copies) costs comparisons linear in its size.

Defined cases: a NULL text or one without words has the empty set, links to
nothing and has its own id as component; a text of fewer words than the n-gram is
one n-gram; rows with a NULL doc_id have a NULL component and are kept; repeated
rows and equal texts are one class; texts of one repeated id count as linked; an
empty table gives no rows; only doc_id and text are read, so extra columns may have
any name.  Whole texts count, however long.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import doc_texts, map_arrow, materialise, release
from fleetlens.llm.jaccard_join import shingle_set
from fleetlens.llm.linking import SEEDS, Threshold, class_sets, classes_of, find_components, label, leader_pairs, mix, set_key

SYMBOLS = 64
#: Share of the pairs exactly at the threshold that may lie beyond the signature distance.
MISS = 1e-5
#: Tokens hashed at once: bounds the memory of a batch of long texts.
_SLICE = 1 << 20


def signature_distance(num: int, den: int, symbols: int = SYMBOLS, miss: float = MISS) -> int:
    """The least distance that more than 1 - miss of the pairs at similarity num / den keep to."""
    p, tail = 1 - num / den, 1.0
    for d in range(symbols + 1):
        tail -= comb(symbols, d) * p ** d * (1 - p) ** (symbols - d)
        if tail <= miss:
            return d
    return symbols


def minima(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    """The signature of each non-empty set: (sets, symbols) of 16 bits."""
    factors = mix(np.arange(1, symbols + 1, dtype=np.uint64) * SEEDS[1]) | np.uint64(1)
    out = np.empty((len(sets), symbols), np.uint16)
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + len(sets[stop]) <= _SLICE):
            total += len(sets[stop])
            stop += 1
        tokens = mix(np.concatenate(sets[start:stop]) ^ SEEDS[2])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[start:stop - 1]])]).astype(np.int64)
        for i, f in enumerate(factors):
            out[start:stop, i] = mix(np.minimum.reduceat(tokens * f, at)) >> np.uint64(48)
        start = stop
    return out


def keys(signatures: np.ndarray, distance: int) -> np.ndarray:
    """(rows, symbols) keys: for every chunk and each of its symbols, the others."""
    n, symbols = signatures.shape
    chunks = np.array_split(np.arange(symbols), min(symbols, distance // 2 + 1))
    values = signatures.astype(np.uint64) + np.uint64(1)
    weighed = mix(values * SEEDS[0] + np.arange(symbols, dtype=np.uint64) * SEEDS[3])
    out = np.empty((n, symbols), np.uint64)
    for at in chunks:
        whole = weighed[:, at].sum(axis=1, dtype=np.uint64)
        out[:, at] = mix(whole[:, None] - weighed[:, at] + at.astype(np.uint64) * SEEDS[1])
    return out


def _profiles(texts: DataFrame, width: int, how: Threshold, distance: int) -> DataFrame:
    """doc_id, n, k1, k2, signature and keys (sigs); of equal sets in one batch
    only the first carries keys, and none that only an equal set can link to."""
    num, den = how.num, how.den

    def run(batches):
        for b in batches:
            ids, rows, full, carrier, seen = b.column(0), [], [], [], set()
            for i, (known, text) in enumerate(zip(ids.is_valid().to_pylist(), b.column(1).to_pylist(), strict=True)):
                t = shingle_set(text, width)
                key = set_key(t)
                rows.append(key)
                n = len(t)
                if known and key not in seen and (n + n * den // num) * (den - num) // (den + num):
                    seen.add(key)
                    carrier.append(i)
                    full.append(t)
            signatures = minima(full) if full else np.empty((0, SYMBOLS), np.uint16)
            has = np.zeros(len(rows), np.int32)
            has[carrier] = 1
            ends = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
            k = np.array(rows, np.uint64).reshape(-1, 3)
            packed = iter(signatures)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(k[:, 2].astype(np.int64)), pa.array(k[:, 0].view(np.int64)), pa.array(k[:, 1].view(np.int64)),
                 pa.array([next(packed).tobytes() if h else None for h in has], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends * SYMBOLS), pa.array(keys(signatures, distance).reshape(-1).view(np.int64)))],
                names=["doc_id", "n", "k1", "k2", "signature", "sigs"])

    return materialise(map_arrow(texts, run, "doc_id long, n long, k1 long, k2 long, signature binary, sigs array<long>", "words"), "profiles")


def within(pairs: DataFrame, signatures: DataFrame, distance: int) -> DataFrame:
    """The pairs (a, b) whose signatures (id, signature) differ in at most ``distance`` symbols."""
    both = (pairs.join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a")
            .join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b").select("a", "b", "x", "y"))

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in (2, 3))
            near = pa.array((x != y).sum(axis=1) <= distance)
            yield b.select(["a", "b"]).filter(near)

    return map_arrow(both, run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept (the
    component's smallest id), for links den * |intersection| >= num * |union|."""
    how, distance = Threshold(num, den), signature_distance(num, den)
    texts = doc_texts(docs)
    profiles = _profiles(texts, width, how, distance)
    classes = classes_of(profiles)
    pairs = leader_pairs(profiles, classes)
    carriers = (profiles.where("signature is not null").join(classes, ["k1", "k2", "n"])
                .groupBy("node").agg(F.min("signature").alias("signature")).withColumnRenamed("node", "id"))  # equal sets, equal signatures
    near = materialise(within(pairs.where(how.alike("n_a", "n_b")), carriers, distance), "near")
    sets = class_sets(texts, pairs, classes, lambda text: shingle_set(text, width))
    found = find_components(pairs, sets, classes, how, plausible=lambda _: near)
    release(pairs, sets, near)
    done = label(profiles, classes, found)
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
