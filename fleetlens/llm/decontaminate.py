"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words (A-Z lower-cased, every other ASCII
non-alphanumeric byte a separator).  Each window of ``window`` consecutive item
words - an item with fewer words is one window - is a pattern.  Every distinct
word of the items has a code of a fixed number of symbols, a different 64 of them
at each place, so no node of the automaton has more than 64 branches however
many words there are, and a match can only start where a word does.  A document
is the string of its words' codes, unknown words being symbols that no pattern
contains.  The automaton reads every document once; match positions are word
positions, mapped back to character offsets of the original text for the documents
that are hit.

The automaton goes to the executors only in blocks of at most about
``block_nodes`` nodes: a benchmark above that is hashed (by window and item) into
as many blocks as it needs, the documents are scanned once per block, and the hits
are merged per document, so the result does not depend on the block count.  A
worker process builds a block's automaton once.

Defined cases: a NULL, empty or separator-only text has no words and no hits; a
NULL item or item without words has no windows; an item with a NULL id marks
words as hit but is not listed among the items.  Repeated item ids count once.
Repeated document rows each give a row.  An empty documents table gives no rows,
an empty benchmark no hits.  Whole texts are scanned, however long.  Only doc_id,
text and item_id are read, so extra columns may have any name.
"""

from __future__ import annotations

import re
import uuid
from itertools import product, repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import annotate, doc_texts, quoted, stored

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_BYTES = re.compile(WORD.encode("latin-1"))
# Every ASCII byte that is no lower-case letter or digit separates words; bytes
# of multi-byte characters are word bytes.
_TO_WORDS = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz"
                  else c + 32 if chr(c) in ASCII_UPPER else 32 for c in range(256))

FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_SPAN = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (item_id string, words of one window)."""
    low = F.translate(F.col("text").cast("string"), ASCII_UPPER, ASCII_UPPER.lower())
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (words.select("item_id", "w", F.explode(starts).alias("s"))
            .select("item_id", F.slice("w", F.col("s") + 1, window).alias("words")).distinct())


#: Nodes of a block's automaton (about 100 bytes each in a worker).
BLOCK_NODES = 10_000_000
#: Branches of an automaton node.
BRANCHES = 64


def word_codes(words: list[bytes]) -> tuple[dict[bytes, str], int]:
    """A code for each distinct word, and the symbols in a code."""
    width = 1
    while BRANCHES ** width < len(words):
        width += 1
    places = [[chr(1 + BRANCHES * at + i) for i in range(BRANCHES)] for at in range(width)]
    return dict(zip(words, map("".join, product(*places)))), width  # noqa: B905  codes may be left over


class Matcher:
    """Automaton of one block of windows."""

    def __init__(self, windows: list[tuple[str | None, list[str]]]):
        coded = [(item, [w.encode("utf-8") for w in words]) for item, words in windows]
        self.symbol, self.width = word_codes(list(dict.fromkeys(w for _, words in coded for w in words)))
        by_pattern: dict[str, list[str | None]] = {}
        for item, words in coded:
            by_pattern.setdefault("".join(map(self.symbol.__getitem__, words)), []).append(item)
        self.automaton = ahocorasick.Automaton()
        for key, items in by_pattern.items():
            self.automaton.add_word(key, (len(key) // self.width, [i for i in items if i is not None]))
        if by_pattern:
            self.automaton.make_automaton()
        self.empty = not by_pattern

    def find(self, text: str | None) -> tuple[int, list[dict], list[str]]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.translate(_TO_WORDS).split()
        if not words or self.empty:
            return len(words), [], []
        line = "".join(map(self.symbol.get, words, repeat("\0" * self.width)))
        merged: list[list[int]] = []
        items: set[str] = set()
        for end, (length, ids) in self.automaton.iter(line):
            stop = end // self.width + 1
            first = stop - length
            items.update(ids)
            while merged and merged[-1][0] >= first:  # ends ascend, starts need not
                merged.pop()
            if merged and merged[-1][1] >= first:
                merged[-1][1] = stop
            else:
                merged.append([first, stop])
        return len(words), self._offsets(raw, merged), sorted(items)

    @staticmethod
    def _offsets(raw: bytes, merged: list[list[int]]) -> list[dict]:
        """Word positions as code-point offsets of the original text."""
        if not merged:
            return []
        at = [m.span() for m in _WORD_BYTES.finditer(raw.translate(_TO_WORDS))]
        out, done_byte, done_char = [], 0, 0
        for first, stop in merged:
            where = []
            for b in (at[first][0], at[stop - 1][1]):
                done_char += len(raw[done_byte:b].decode("utf-8", "surrogatepass"))
                done_byte = b
                where.append(done_char)
            out.append({"first_word": first, "end_word": stop, "start": where[0], "end": where[1]})
        return out


def _matcher(name: str, windows) -> Matcher:
    """The matcher of one block; a worker process keeps the last one."""
    return stored("matcher", name, lambda: Matcher(windows.value))


def _scan(docs: DataFrame, windows: list, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    shared, block = docs.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex

    def factory():
        matcher = _matcher(block, shared)

        def score(texts):
            found = [matcher.find(t) for t in texts]
            return [pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.list_(_SPAN)),
                    pa.array([f[2] for f in found], pa.list_(pa.string()))]
        return score

    return annotate(docs, "text", FOUND, factory, keep, "matcher")


def _blocks(benchmark: DataFrame, window: int, block_nodes: int) -> list[DataFrame]:
    wins = item_windows(benchmark, window)
    # Four symbols a word (up to 16 million words); windows that begin alike share nodes, so there are fewer.
    total = wins.agg(F.coalesce(F.sum(F.size("words").cast("long") * 4), F.lit(0)).alias("c")).first()["c"]
    n = max(1, -(-total // block_nodes))
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(n))
    return [wins if n == 1 else wins.where(block == i) for i in range(n)]


def _load(block: DataFrame) -> list:
    """One block, of bounded size, on the driver."""
    return [(r.item_id, r.words) for r in block.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                  block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Per document: doc_id, n_words, spans (merged; word and character ranges,
    end exclusive) and the sorted ids of the items with an occurring window."""
    texts = doc_texts(docs)
    blocks = _blocks(benchmark, window, block_nodes)
    if len(blocks) == 1:
        df, name = _scan(texts, _load(blocks[0]), ["doc_id"])
        return df.select("doc_id", f"{name}.n_words", f"{name}.spans", f"{name}.items")
    parts = []
    for i, b in enumerate(blocks):
        df, name = _scan(texts.withColumn("h", F.sha2("text", 256)), _load(b), ["doc_id", "h"])
        parts.append(df.select("doc_id", "h", F.lit(i).alias("block"),
                               f"{name}.n_words", f"{name}.spans", f"{name}.items"))
    return _merge(parts)


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Union of the blocks' spans and items; equal rows keep their number."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    per_doc = every.groupBy("doc_id", "h").agg(
        F.sum((F.col("block") == 0).cast("int")).alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merge = """aggregate(s, cast(array() as array<struct<first_word:bigint,end_word:bigint,start:bigint,end:bigint>>),
        (a, x) -> case when size(a) > 0 and element_at(a, -1).end_word >= x.first_word
          then concat(slice(a, 1, size(a) - 1), array(named_struct(
            'first_word', element_at(a, -1).first_word,
            'end_word', greatest(element_at(a, -1).end_word, x.end_word),
            'start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end))))
          else concat(a, array(x)) end)"""
    return per_doc.select("doc_id", "n_words", F.expr(merge).alias("spans"), "items",
                          F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("_")).drop("_")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's spans and items."""
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end_word - s.first_word)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                      block_nodes: int = BLOCK_NODES) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no window occurs."""
    kept = docs
    for b in _blocks(benchmark, window, block_nodes):
        df, name = _scan(kept, _load(b))
        kept = df.where(F.size(f"{name}.spans") == 0).select(*quoted(docs.columns))
    return kept
