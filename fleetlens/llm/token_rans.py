"""Token-ID files with a static range asymmetric numeral system (rANS).

Documents are dealt to ranges of ascending doc_id, tokenised, and written as
shard images, one binary row of a Parquet data set each, which Spark commits
atomically.  A shard holds up to ``shard_ids`` ids (or one longer document):

    magic  symbols  blocks                                header, 3 x uint32
    symbol ids (uint32), frequencies (uint32)             shared table, sum 2^20
    per block: documents, ids, words, lanes, checkpoints, crc32 of the ids and of the body
    body of a block: doc_id (int64), known (uint8), length (uint32) by
               document; checkpoint offsets (uint32) and lane states (uint64); words

All blocks of a shard use its frequency table and are independent otherwise.  A
block holds whole documents, its ids interleaved over LANES coder states of 64
bits that share one stream of 32-bit words.  Every CHECKPOINT_STEPS steps the
states and the stream position are kept, so a decoder can start in the middle
(``decode_ids(block, first, last)``) and parts of a block can be decoded in
parallel.  The checksums of every block are verified when it is read.

Defined cases: a NULL text is empty and gives only the end id; a NULL doc_id
sorts first; rows of equal doc_id are ordered by the hash of the text and the
text; an empty table writes no shard.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import doc_texts, map_arrow, stored
from fleetlens.session import scratch_path

MAGIC = 0x31534E52
SCALE_BITS = 20
LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63)
LANES = 1024
CHECKPOINT_STEPS = 128
BLOCK_IDS = 1 << 18
END_ID = 1


# --- tokenising -----------------------------------------------------------

#: White space on which the word split below and a tokenizer's own might disagree, letters whose lower case depends on
#: their neighbours, and NUL, which parts texts here.  Texts with one of these or a mark of special tokens are encoded in one piece.
_ODD = np.zeros(1 << 16, bool)
_ODD[[ord(c) for c in map(chr, range(1 << 16)) if re.match(r"[\x00\x1c-\x1f\x85\xa0  -     　İΣ]", c)]] = True
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Characters cut and looked up at once.
PIECE_CHARS = 1 << 18
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2^64, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.known):
            self.known = np.concatenate([np.ones(1, np.uint64), np.full(2 * n, np.uint64(self.base)).cumprod(dtype=np.uint64)])
        return self.known[:n]


class _Words:
    """Ids of known words in one pool, or only their number, found by the words'
    64-bit hashes."""

    def __init__(self, only_counts: bool):
        self.only_counts = only_counts
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.start, self.count, self.pool = [], [], []
        self.n = self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for an unknown one; the keys are sorted."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        count = np.array([len(x) // 4 for x in ids], np.int32)
        self.count.append(count)
        if not self.only_counts:
            self.start.append(self.size + np.cumsum(count, dtype=np.int64) - count)
            self.pool.append(np.frombuffer(b"".join(ids), "<u4"))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, self.n + np.arange(len(keys)))
        self.n, self.size = self.n + len(keys), self.size + int(count.sum())

    def whole(self, name: str) -> np.ndarray:
        """``start`` (first place in the pool) or ``count`` (ids) of each slot, or the ``pool``."""
        parts = getattr(self, name)
        if len(parts) > 1:
            setattr(self, name, [np.concatenate(parts)])
        return getattr(self, name)[0]


class WordTokenizer:
    """Encodes whole texts through a cache of words, many texts at a time: words
    are cut, hashed (64 bits) and looked up as arrays.

    Right for tokenizers that lower-case, drop white space and never join
    across it, as the default vocabulary's does; a text with unusual white
    space or special-token marks is encoded in one piece instead.  With
    ``only_counts`` it keeps no ids of words, a third of the memory.
    """

    def __init__(self, path: str, cache_words: int = 1_500_000, only_counts: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.cache, self.cache_words = Tokenizer.from_file(path), _Words(only_counts), cache_words
        self.power, self.inverse = _Powers(_P), _Powers(_P_INVERSE)
        self.letters, self.last = self._letter_tokenizer()

    def _letter_tokenizer(self):
        """A tokenizer of the same model without normalising and pattern
        splitting, for lower-case words of letters between spaces, and which ids
        end a word.  None unless the model marks the ends of words and the
        tokenizer splits bytes as this one does."""
        from tokenizers import Tokenizer, models, pre_tokenizers
        model, split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        suffix, split = getattr(model, "end_of_word_suffix", None), "" if split is None else split.__getstate__().decode()
        if not isinstance(model, models.BPE) or not suffix or "ByteLevel" not in split or r"[\\p{L}]+" not in split:
            return None, None
        letters = Tokenizer(model)  # shares the model
        letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return letters, last

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: each is one pre-token, so many are
        encoded as one text and cut where a word ends."""
        out = []
        for i in range(0, len(words), 4096):
            part = words[i:i + 4096]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(cut) != len(part) or cut[-1] != 4 * len(ids):  # the tokenizer sees other words
                out += self._ids(part)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in pairwise([0, *cut])]
        return out

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha() and unicodedata.is_normalized("NFC", w)] if self.letters else []
        other = sorted(set(range(len(words))).difference(plain))
        for places, ids in ((plain, self._ids_of_letters([words[i] for i in plain])), (other, self._ids([words[i] for i in other]))):
            for i, x in zip(places, ids, strict=True):
                out[i] = x
        return out

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The cache slots of the words of all texts in order, and where each
        text's words end.  The texts hold no NUL, which parts them here."""
        raw = np.frombuffer("\n\0\n".join(texts).lower().encode("utf-8", "surrogatepass"), np.uint8)
        edge = np.flatnonzero(np.diff(_SPACES[raw], prepend=True, append=True))
        first, last = edge[::2], edge[1::2]
        # A comma or full stop after a letter is a word of its own.
        end, before = raw[last - 1], raw[np.maximum(last - 2, 0)]
        two = ((end == 44) | (end == 46)) & (last - first > 1) & (before >= 97) & (before <= 122)
        at = np.cumsum(1 + two)
        first, last = np.repeat(first, 1 + two), np.repeat(last, 1 + two)
        first[at[two] - 1] = last[at[two] - 2] = last[at[two] - 1] - 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * self.power.upto(len(raw)), dtype=np.uint64)])
        keys = (total[last] - total[first]) * self.inverse.upto(len(raw) + 1)[first] + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mark = (last - first == 1) & (raw[first] == 0)
        ends = np.concatenate([np.flatnonzero(mark) - np.arange(mark.sum()), [len(first) - mark.sum()]])
        first, last, keys = first[~mark], last[~mark], keys[~mark]
        unique, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if self.cache.n + len(unique) > self.cache_words:
            self.cache = _Words(self.cache.only_counts)
        slots = self.cache.find(unique)
        gaps = np.flatnonzero(slots < 0)
        if len(gaps):
            data = raw.tobytes()
            words = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(first[where[gaps]].tolist(), last[where[gaps]].tolist(), strict=True)]
            slots[gaps] = self.cache.n + np.arange(len(gaps))
            self.cache.add(unique[gaps], self._ids_of_words(words))
        return slots[back], ends

    @staticmethod
    def _simple(texts: list[str]) -> list[bool]:
        """Which texts are words between plain white space."""
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        odd = _ODD[np.minimum(cp, 0xFFFF)]
        odd[:-1] |= (cp[:-1] == 60) & (cp[1:] == 124)
        stops = np.cumsum([len(t) + 1 for t in texts])
        out = np.ones(len(texts), bool)
        out[np.searchsorted(stops, np.flatnonzero(odd), side="right")] = False
        return out.tolist()

    @staticmethod
    def _pieces(text: str) -> list[str]:
        """A long text cut at spaces, which no word spans."""
        out, at = [], 0
        while len(text) - at > PIECE_CHARS and (stop := text.find(" ", at + PIECE_CHARS)) >= 0:
            out.append(text[at:stop])
            at = stop
        return [*out, text[at:]]

    def _in_groups(self, texts: list[str], whole, some):
        """``some`` of the simple texts, a bounded number of characters at a
        time, and ``whole`` of each other one; long texts give several parts."""
        parts = [(i, p, s) for i, (t, s) in enumerate(zip(texts, self._simple(texts), strict=True)) for p in (self._pieces(t) if s else [t])]
        found = [[] for _ in texts]
        group, size = [], 0
        for k, (i, p, s) in enumerate(parts):
            if s:
                group.append((i, p))
                size += len(p)
            else:
                found[i].append(whole(p))
            if group and (size >= PIECE_CHARS or k == len(parts) - 1):
                for (j, _), x in zip(group, some([p for _, p in group]), strict=True):
                    found[j].append(x)
                group, size = [], 0
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        return [b"".join(f) for f in self._in_groups(texts, lambda t: self._ids([t])[0], self._encode)]

    def counts(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        return [sum(f) for f in self._in_groups(texts, lambda t: len(self._ids([t])[0]) // 4, self._counts)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        slots, ends = self._slots(texts)
        if not len(slots):
            return [b""] * len(texts)
        start, count, pool = map(self.cache.whole, ("start", "count", "pool"))
        n = count[slots]
        stop = np.cumsum(n)
        raw = pool[np.repeat(start[slots] - (stop - n), n) + np.arange(stop[-1])].tobytes()
        return [raw[a:b] for a, b in pairwise([0, *(4 * np.concatenate([[0], stop])[ends]).tolist()])]

    def _counts(self, texts: list[str]) -> list[int]:
        slots, ends = self._slots(texts)
        if not len(slots):
            return [0] * len(texts)
        stop = np.concatenate([[0], np.cumsum(self.cache.whole("count")[slots])])
        return np.diff(stop[ends], prepend=0).tolist()


def shared_tokenizer(path: str, only_counts: bool = False) -> WordTokenizer:
    """One tokenizer, with its cache, for each worker process."""
    return stored("tokenizer", (path, only_counts), lambda: WordTokenizer(path, only_counts=only_counts))


# --- the coder ------------------------------------------------------------

def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, one at least, summing to 2^20."""
    symbols, counts = np.unique(ids, return_counts=True)
    if not len(symbols):
        return symbols.astype(np.uint32), counts.astype(np.uint32)
    scale = 1 << SCALE_BITS
    freq = np.maximum(1, counts * scale // counts.sum())
    spare = scale - int(freq.sum())
    if spare >= 0:
        freq[counts.argmax()] += spare
    else:  # raising rare symbols to one overdrew: take from the most frequent
        for i in np.argsort(-freq, kind="stable"):
            taken = min(-spare, int(freq[i]) - 1)
            freq[i] -= taken
            spare += taken
            if not spare:
                break
    return symbols.astype(np.uint32), freq.astype(np.uint32)


class Table:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """Symbol number of each of the 2^20 slots."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


@dataclass
class Block:
    """Interleaved ids: states[i] and offsets[i] start step i * CHECKPOINT_STEPS."""

    n_ids: int
    offsets: np.ndarray  # uint32 positions in words
    states: np.ndarray   # (checkpoints, lanes) uint64
    words: np.ndarray    # uint32


def encode_ids(table: Table, ids: np.ndarray) -> Block:
    at = np.searchsorted(table.symbols, ids)
    freq, cum = table.freq[at], table.cum[at]
    limit = freq << np.uint64(63 - SCALE_BITS)
    lanes = min(LANES, max(1, len(ids)))
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, LOW)
    emitted: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    kept: dict[int, np.ndarray] = {}
    for step in range(steps - 1, -1, -1):
        part = slice(step * lanes, min(len(ids), (step + 1) * lanes))
        f, y = freq[part], x[:part.stop - part.start]
        over = y >= limit[part]
        if over.any():
            emitted[step] = y[over].astype(np.uint32)
            y = np.where(over, y >> np.uint64(32), y)
        q = y // f
        x[:len(y)] = (q << np.uint64(SCALE_BITS)) + (y - q * f) + cum[part]
        if step % CHECKPOINT_STEPS == 0:
            kept[step // CHECKPOINT_STEPS] = x.copy()
    sizes = np.cumsum([0] + [len(e) for e in emitted])
    n = max(1, len(kept))
    states = np.stack([kept[i] for i in range(n)]) if kept else x[None, :]
    return Block(len(ids), sizes[:-1][::CHECKPOINT_STEPS].astype(np.uint32) if steps else np.zeros(1, np.uint32), states,
                 np.concatenate([*emitted, np.empty(0, np.uint32)]))


def decode_ids(table: Table, block: Block, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first..last-1 of a block, from the nearest checkpoint before."""
    last = block.n_ids if last is None else last
    if first >= last:
        return np.empty(0, np.uint32)
    lanes = block.states.shape[1]
    check = first // lanes // CHECKPOINT_STEPS
    step, at = check * CHECKPOINT_STEPS, int(block.offsets[check])
    x, start = block.states[check].copy(), step * lanes
    mask, scale, slots = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), table.slots
    out = []
    while step * lanes < last:
        width = min(lanes, block.n_ids - step * lanes)
        y = x[:width]
        slot = y & mask
        s = slots[slot.astype(np.int64)]
        out.append(s)
        y = table.freq[s] * (y >> scale) + slot - table.cum[s]
        under = np.flatnonzero(y < LOW)
        if len(under):
            y[under] = y[under] << np.uint64(32) | block.words[at:at + len(under)]
            at += len(under)
        x[:width] = y
        step += 1
    return table.symbols[np.concatenate(out)][first - start:last - start]


# --- shard images ---------------------------------------------------------

_HEAD = struct.Struct("<III")
_BLOCK = struct.Struct("<IIIIIII")


def shard_image(docs: list[tuple[int | None, bytes]]) -> bytes:
    """Image of documents (id, ids as bytes) in order."""
    table = Table(*frequencies(np.frombuffer(b"".join(b for _, b in docs), "<u4")))
    heads, bodies, first = [], [], 0
    while first < len(docs):
        stop, n = first, 0
        while stop < len(docs) and (stop == first or n + len(docs[stop][1]) // 4 <= BLOCK_IDS):
            n += len(docs[stop][1]) // 4
            stop += 1
        part = docs[first:stop]
        raw = b"".join(b for _, b in part)
        block = encode_ids(table, np.frombuffer(raw, "<u4"))
        body = b"".join([
            np.array([i or 0 for i, _ in part], "<i8").tobytes(), np.array([i is not None for i, _ in part], np.uint8).tobytes(),
            np.array([len(b) // 4 for _, b in part], "<u4").tobytes(), block.offsets.astype("<u4").tobytes(),
            block.states.astype("<u8").tobytes(), block.words.astype("<u4").tobytes()])
        heads.append(_BLOCK.pack(len(part), n, len(block.words), block.states.shape[1], len(block.offsets), zlib.crc32(raw), zlib.crc32(body)))
        bodies.append(body)
        first = stop
    return b"".join([_HEAD.pack(MAGIC, len(table.symbols), len(heads)), table.symbols.astype("<u4").tobytes(),
                     table.freq.astype("<u4").tobytes(), *heads, *bodies])


def read_shard(image: bytes):
    """Yields, for each block, (doc ids, lengths, ids), the checksum verified."""
    magic, n_symbols, n_blocks = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = _HEAD.size

    def take(dtype, n):
        nonlocal at
        got = np.frombuffer(image, dtype, n, at)
        at += got.nbytes
        return got

    table = Table(take("<u4", n_symbols), take("<u4", n_symbols))
    heads = [_BLOCK.unpack_from(image, at + i * _BLOCK.size) for i in range(n_blocks)]
    at += n_blocks * _BLOCK.size
    for docs, n_ids, n_words, lanes, checks, crc, body_crc in heads:
        size = docs * 13 + checks * (4 + 8 * lanes) + n_words * 4
        if zlib.crc32(memoryview(image)[at:at + size]) != body_crc:
            raise ValueError("token block is damaged")
        doc_ids, known, lengths = take("<i8", docs), take(np.uint8, docs), take("<u4", docs)
        offsets, states = take("<u4", checks), take("<u8", checks * lanes).reshape(checks, lanes)
        ids = decode_ids(table, Block(n_ids, offsets, states, take("<u4", n_words))).astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("token block fails its checksum")
        yield [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], lengths, ids


# --- Spark jobs -----------------------------------------------------------

def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, shard_ids: int = 1 << 22, end_id: int = END_ID) -> None:
    """Tokenise all documents and write the shards below ``path``."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        part, seq, docs_of, size = TaskContext.get().partitionId(), 0, [], 0
        tokenizer = shared_tokenizer(tokenizer_path)

        def image():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs_of)], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([shard_image(docs_of)], pa.binary())],
                names=["part", "seq", "docs", "ids", "image"])

        for b in batches:
            for i in range(0, b.num_rows, 512):
                ids, texts = b.column(0).slice(i, 512).to_pylist(), b.column(1).slice(i, 512).to_pylist()
                for doc, raw in zip(ids, tokenizer.encode([t or "" for t in texts]), strict=True):
                    n = len(raw) // 4 + 1
                    if docs_of and size + n > shard_ids:
                        yield image()
                        seq, docs_of, size = seq + 1, [], 0
                    docs_of.append((doc, raw + end))
                    size += n
        if docs_of:
            yield image()

    # Rows of one id are split by their text, equal rows, which are alike in every respect, by where they were read.
    rows = (doc_texts(docs).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id())
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"))
    (map_arrow(rows, encode, "part int, seq int, docs long, ids long, image binary", "tokenizer")
     .write.option("compression", "none").parquet(path))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 and, if asked for, ids (little-endian 32-bit bytes)."""
    shards = spark.read.schema("part int, seq int, docs long, ids long, image binary").parquet(path)

    def decode(batches):
        for b in batches:
            for part, seq, image in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                within = 0
                for doc_ids, lengths, ids in read_shard(image):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    raw = [ids[e - n:e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                    n = len(doc_ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(doc_ids, pa.int64()),
                         pa.array(within + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)),
                         pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(raw if with_ids else [None] * n, pa.binary())],
                        names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32", "ids"])
                    within += int(ends[-1])

    docs = map_arrow(shards.select("part", "seq", "image"), decode,
                     "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary")
    return (docs.join(_shard_starts(shards), ["part", "seq"])
            .select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids"))


def _shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard, from the count columns alone: first over the
    ranges (a row for each), then inside a range."""
    sizes = shards.select("part", "seq", F.col("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inside"))
            .join(parts, "part").select("part", "seq", (F.col("ahead") + F.col("inside")).alias("base")))


def token_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the corpus as token files in the shared folder, read them back,
    and return doc_id, start, n_tokens and ids_crc32."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(docs.sparkSession, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
