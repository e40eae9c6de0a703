"""Exact links and components of sets that meet in the buckets of an index.

An index gives every set some 64-bit keys and promises that two sets which may
link share a key.  Of the sets of one key (a bucket) the one with the smallest
id leads, and everything below is linear in the size of a bucket:

1. Every member is compared with the leader of each of its buckets, exactly.
   Linked sets are joined to components.
2. A bucket whose members still lie in several components is a family of its
   leader.  Members are written as their differences from a set in the middle of
   the family: the member nearest to the tokens that most members hold.  All
   members are compared with that one as well.
3. Members that share at least the part t (the threshold) of their own tokens
   with the middle are around it, the others are far.  If x and y, both around,
   differ from the middle in d and e tokens, they differ from each other in
   d + e - 2 s, s being the number of differences they share.  Two sets of sizes
   n and m link only if they differ in at most H(n, m) tokens, so a link needs
   s >= (d + e - H) / 2 shared differences.  Both being in different components,
   one is not linked to the middle, so s is at least 1.
4. All far members lack most of the middle, so the tokens they lack tell them
   apart badly and are many.  If x is far, it shares b < t n tokens with the
   middle; a link with y needs O(n, m) >= t n tokens in common, of which the
   middle has min(b, b') at most.  So x and y share at least O - min(b, b') >= 1
   of the tokens that they have and the middle has not.
5. For both kinds an inverted index of the rarest such tokens (prefix filtering)
   gives the pairs that can reach that number; tokens that only members of one
   component have never make a pair.  The pairs are compared exactly.

So every pair of a bucket that could join two components is either compared or
ruled out by the bound: nothing is capped, dropped or sampled.

Sets are arrays of 64-bit hashes of the n-grams.  Rows of one hot key are spread
by joins that AQE may split; counts are aggregated before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import map_arrow, materialise, release, small
from fleetlens.llm.components import components

#: Times that families are handed over to a common smallest leader.
HAND_OVERS = 2
SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising hash of 64-bit integers."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


@dataclass(frozen=True)
class Threshold:
    """Link when den * |intersection| >= num * |union|."""

    num: int
    den: int

    def differences(self, total: str) -> str:
        """SQL: the most tokens that linked sets of this total size differ in."""
        return f"(({total}) * {self.den - self.num} div {self.den + self.num})"

    def common(self, total: str) -> str:
        """SQL: the least tokens that linked sets of this total size have in common."""
        return f"((({total}) * {self.num} + {self.num + self.den - 1}) div {self.num + self.den})"

    def of_own(self, n: str) -> str:
        """SQL: the least tokens that a set of this size has in common with any it is linked to."""
        return f"((({n}) * {self.num} + {self.den - 1}) div {self.den})"

    def alike(self, n: str, m: str) -> str:
        """SQL: whether sets of these sizes may link."""
        return f"{self.den} * least({n}, {m}) >= {self.num} * greatest({n}, {m})"

    def linked(self, n: Column, m: Column, both: Column) -> Column:
        return self.den * both >= self.num * (n + m - both)


def classes_of(profiles: DataFrame) -> DataFrame:
    """(k1, k2, n, id, node): equal non-empty sets are one class of documents,
    named by the smallest doc_id.  ``node`` stands for the class in links: that
    id, or a number from 2^62 on for further classes of one id (an id repeated
    with different texts)."""
    sets = profiles.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id"))
    sets = materialise(sets, "sets_of")
    first = sets.groupBy("id").agg(F.min(F.struct("k1", "k2", "n")).alias("first"))
    other = F.lit(1 << 62) + F.pmod(F.xxhash64("k1", "k2", "n"), F.lit(1 << 61))
    classes = sets.join(first, "id").select("k1", "k2", "n", "id", F.when(F.struct("k1", "k2", "n") == F.col("first"), F.col("id")).otherwise(other).alias("node"))
    classes = materialise(classes, "classes")
    release(sets)
    return classes


def leader_pairs(profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of classes: the leader of a bucket and each other member,
    once, and the sizes of their sets.

    Leaders are a grouped minimum, aggregated before the shuffle; a key that one
    document has alone goes no further.
    """
    rows = profiles.select(F.explode("sigs").alias("sig"), "doc_id")
    lead = (rows.groupBy("sig").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a != last").select("sig", "a"))
    lead = materialise(lead, "leaders")
    met = materialise(rows.join(lead.hint("shuffle_hash"), "sig").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct(), "met")
    release(lead)
    # From documents to their classes; copies of one class are no pair.
    name = materialise(profiles.select("doc_id", "k1", "k2", "n").where("n > 0 and doc_id is not null")
                       .join(classes, ["k1", "k2", "n"]).select("doc_id", "node", "n").distinct(), "names")
    rows = name.count()
    pairs = (met.join(small(name.select(F.col("doc_id").alias("a"), F.col("node").alias("ca"), F.col("n").alias("n_a")), rows), "a")
             .join(small(name.select(F.col("doc_id").alias("b"), F.col("node").alias("cb"), F.col("n").alias("n_b")), rows), "b")
             .where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "n_a", "n_b").distinct())
    pairs = materialise(pairs, "pairs")  # a is the leader's class, also where another class has a smaller number
    release(met, name)
    return pairs


def class_sets(texts: DataFrame, pairs: DataFrame, classes: DataFrame, sets_of, few: int = 2_000_000) -> DataFrame:
    """(id, tokens) of every class that a comparison may need; ``sets_of`` makes
    the set of a text.  Up to ``few`` ids (16 MB of longs) may be broadcast."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = materialise(nodes.join(classes, "node").select("node", "id", "k1", "k2", "n"), "needed")
    ids = needed.select(F.col("id").alias("doc_id"))
    rows = needed.count()
    wanted = texts.join(F.broadcast(ids) if rows <= few else ids, "doc_id", "left_semi").select("text")

    def run(batches):
        for b in batches:
            keys, flat, ends, seen = [], [], [0], set()
            for text in b.column(0).to_pylist():
                t = sets_of(text)
                key = set_key(t)
                if len(t) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    flat.append(t)
                    ends.append(ends[-1] + len(t))
            k = np.array(keys, np.uint64).reshape(-1, 3).view(np.int64)
            tokens = np.concatenate([*flat, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(k[:, i])) for i in range(3)),
                                              pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(tokens))], names=["k1", "k2", "n", "tokens"])

    made = map_arrow(wanted, run, "k1 long, k2 long, n long, tokens array<long>", "words")
    sets = made.join(small(needed, rows), ["k1", "k2", "n"]).groupBy("node").agg(F.first("tokens").alias("tokens"))
    sets = materialise(sets.withColumnRenamed("node", "id"), "sets")
    release(needed)
    return sets


def set_key(tokens: np.ndarray) -> tuple[int, int, int]:
    """128-bit hash of a set of hashes, and its size."""
    return int(mix(tokens + SEEDS[0]).sum()), int(mix(tokens ^ SEEDS[3]).sum()), len(tokens)


def find_components(pairs: DataFrame, sets: DataFrame, classes: DataFrame, how: Threshold, plausible=None) -> DataFrame:
    """(id, component) of every class that is linked.

    ``pairs`` are leaders and members (a, b), each once, ``sets`` (id, tokens).
    ``plausible`` may drop pairs that their sizes or an index rule out before
    they are compared.
    """
    near = pairs if plausible is None else plausible(pairs)
    same = classes.where("id != node").select(F.col("id").alias("a"), F.col("node").alias("b"))  # texts of one id
    links = materialise(_compared(near, sets, how).where("linked").select("a", "b").unionByName(same), "links")
    found = materialise(components(links), "components")
    release(links)
    members = _open_families(pairs, found)
    if members is None:
        return found
    both = _within_families(members, found, sets, how)
    release(found, members)
    return both


def label(profiles: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (NULL for a NULL id)."""
    # Copies of one class are joined to one row; AQE splits a hot class.
    named = classes.join(found.withColumnRenamed("id", "node"), "node", "left").select("k1", "k2", "n", F.coalesce("component", "id").alias("component"))
    rep = profiles.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    return rep.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _compared(pairs: DataFrame, sets: DataFrame, how: Threshold) -> DataFrame:
    """(a, b, linked), decided on the whole sets."""
    both = (pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a"))
    return both.select("a", "b", how.linked(F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))).alias("linked"))


def _with_component(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(small(found, found.count()), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _open_families(pairs: DataFrame, found: DataFrame) -> DataFrame | None:
    """The memberships (lead, id), the leader included, of families in which a
    pair is undecided: their members besides the leader lie in several
    components.  None if there are none.

    The buckets of one group of near copies have many leaders whose families are
    much the same.  A family of which most members have the same smallest leader is
    handed over to that one, as a whole, so every pair still shares a family;
    memberships never become more by that."""
    others = pairs.select(F.col("a").alias("lead"), F.col("b").alias("id"))
    wide = (_with_component(others, found).groupBy("lead").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where("lo != hi").select("lead"))
    kept = materialise(others.join(wide, "lead", "left_semi").unionByName(wide.select("lead", F.col("lead").alias("id"))), "families")
    rows = kept.count()
    if not rows:
        release(kept)
        return None
    for _ in range(HAND_OVERS):
        home = kept.groupBy("id").agg(F.min("lead").alias("home"))
        votes = kept.join(small(home, rows), "id").groupBy("lead", "home").agg(F.count("*").alias("n"))
        most = votes.groupBy("lead").agg(F.sum("n").alias("members"), F.max(F.struct("n", "home")).alias("most"))
        to = most.where("2 * most.n > members").select("lead", F.col("most.home").alias("to"))
        last = kept
        kept = materialise(last.join(small(to, rows), "lead", "left").select(F.coalesce("to", "lead").alias("lead"), "id").distinct(), "families")
        release(last)
    return kept


def _differences(members: DataFrame, sets: DataFrame, centre: str) -> DataFrame:
    """Adds n and m (sizes of the member and of ``centre``), both (tokens they
    share), plus and minus (tokens that only the member, only ``centre`` has)."""
    own = members.join(sets.select("id", F.col("tokens").alias("x")), "id")
    own = own.join(sets.select(F.col("id").alias(centre), F.col("tokens").alias("y")), centre)
    return own.select(*members.columns, F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"),
                      F.array_except("x", "y").alias("plus"), F.array_except("y", "x").alias("minus"))


def _middles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, centre): the member of each family that is nearest to the tokens
    which most members hold."""
    first = materialise(_differences(members, sets, "lead").select("lead", "id", F.concat("plus", "minus").alias("delta")), "first")
    tokens = first.select("lead", F.explode("delta").alias("t"))
    size = first.groupBy("lead").agg(F.count("*").alias("members"))
    # Fewer than two mean differences for each family: one array meets every member, not one row for each of its differences.
    major = (tokens.groupBy("lead", "t").agg(F.count("*").alias("c")).join(small(size, members.count()), "lead").where("2 * c > members")
             .groupBy("lead").agg(F.collect_list("t").alias("major")))
    major = materialise(major, "major")
    far = first.join(major, "lead", "left").select("lead", "id", F.size("delta").alias("d"),
                                                   F.coalesce(F.size(F.array_intersect("delta", "major")), F.lit(0)).alias("h"))
    far = materialise(far, "far")  # the join alone, so AQE may split a large family; the minimum is aggregated before its shuffle
    best = far.groupBy("lead").agg(F.min(F.struct((F.col("d") - 2 * F.greatest("h", F.lit(0))).alias("far"), "id")).alias("best"))
    centres = materialise(best.select("lead", F.col("best.id").alias("centre")), "centres")
    release(first, major, far)
    return centres


def _within_families(members: DataFrame, found: DataFrame, sets: DataFrame, how: Threshold) -> DataFrame:
    """(id, component) with the links inside the families that join different
    components of ``found``."""
    centres = _middles(members, sets)
    around = _differences(members.join(centres, "lead"), sets, "centre")
    around = (around.withColumn("near", how.linked(F.col("n"), F.col("m"), F.col("both")))
              .withColumn("d", F.col("n") + F.col("m") - 2 * F.col("both"))
              .withColumn("missing", F.expr(f"greatest(0, {how.of_own('n')} - both)"))  # more than 0: far
              .withColumn("minus", F.expr("CASE WHEN missing = 0 THEN minus END")))
    around = materialise(around.drop("m"), "around")
    star = around.where("near and id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))
    known = materialise(components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(star)), "components")
    least = around.groupBy("lead").agg(F.expr("min(CASE WHEN missing = 0 AND NOT near THEN d END)").alias("least_d"),  # of those not linked to the middle
                                       F.expr("min(CASE WHEN missing > 0 THEN missing END)").alias("least_missing"))
    each = materialise(_with_component(around, known).join(small(least, centres.count()), "lead"), "each")

    # Both around the middle: the one with more differences asks, the other one answers; (d, id) orders them.
    largest = how.differences(f"n + n * {how.den} div {how.num}")
    by_differences = (_sharing(each.where("missing = 0 and least_d is not null"), F.concat("plus", "minus"))
                      .withColumn("other", F.expr("CASE WHEN near THEN greatest(d, least_d) ELSE d END"))
                      .select("lead", "id", "component", "n", "own", F.col("d").alias("value"), F.col("d").alias("rank"),
                              F.expr(f"d - {largest}").alias("asks"), F.expr(f"(d + other - {largest} + 1) div 2").alias("answers")))
    around_rows = materialise(by_differences.withColumn("k", F.size("own")), "rows")
    differing = _meeting(around_rows, how, f"((value_x + value_y - {how.differences('n_x + n_y')} + 1) div 2)")

    # One far from it, or both: a far one asks.
    by_own = (_sharing(each.where("least_missing is not null"), F.col("plus"))
              .select("lead", "id", "component", "n", "own", F.col("both").alias("value"), F.col("missing").alias("rank"),
                      F.expr("CASE WHEN missing > 0 THEN missing END").alias("asks"), F.expr("CASE WHEN missing > 0 THEN missing ELSE least_missing END").alias("answers")))
    far_rows = materialise(by_own.withColumn("k", F.size("own")), "rows")
    beyond = _meeting(far_rows, how, f"({how.common('n_x + n_y')} - least(value_x, value_y))")

    pairs = materialise(differing.unionByName(beyond).distinct(), "pairs")
    late = materialise(_compared(pairs, sets, how).where("linked").select("a", "b"), "late")
    release(centres, around, each, around_rows, far_rows, pairs)
    if late.isEmpty():
        release(late)
        return known
    both = materialise(components(known.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(late)), "components")
    release(known, late)
    return both


def _sharing(rows: DataFrame, tokens: Column) -> DataFrame:
    """Adds own: those of a row's tokens that members of another component of
    the family have too, the rarest first.  Rows without one are left out."""
    every = rows.select("lead", "id", "component", F.explode(tokens).alias("t"))
    shared = (every.groupBy("lead", "t").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"))
              .where("lo != hi").select("lead", "t", "c"))
    own = (every.join(shared, ["lead", "t"]).groupBy("lead", "id")
           .agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "t"))), lambda x: x["t"]).alias("own")))  # of one document
    return rows.join(own, ["lead", "id"])


def _meeting(rows: DataFrame, how: Threshold, needed: str) -> DataFrame:
    """(a, b) of different components of a family that may share the ``needed``
    number of their ``k`` tokens in ``own``, perhaps several times.  ``asks`` and
    ``answers`` are the least that any pair of the row needs as the higher and as
    the lower one by (rank, id); no ``asks``: the row only answers."""

    def prefix(role: str, at: str) -> DataFrame:
        kept = rows.withColumn("p", F.expr(f"k - greatest(1, {role}) + 1")).where(f"{role} is not null and p > 0")
        return kept.select("lead", F.posexplode(F.expr("slice(own, 1, p)")).alias(f"at_{at}", "t"),
                           *[F.col(c).alias(f"{c}_{at}") for c in ("id", "component", "n", "value", "rank", "k")])

    may = F.expr(f"component_x != component_y and (rank_y, id_y) < (rank_x, id_x) and {how.alike('n_x', 'n_y')}"
                 f" and at_x <= k_x - {needed} and at_y <= k_y - {needed}")
    return (prefix("asks", "x").alias("q").join(prefix("answers", "y").alias("r"), (F.col("q.lead") == F.col("r.lead")) & (F.col("q.t") == F.col("r.t")) & may)
             .select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")))
