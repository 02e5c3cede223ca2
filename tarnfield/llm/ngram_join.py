"""Exact Jaccard self-join of documents' word n-gram sets through a token-group matrix.

1. Every document's set of n-word shingles is hashed (64 bits); documents of equal
   sets (size and two 64-bit sums) are one class, represented by the smallest id.
2. Candidates. A pair of similarity s shares at least s|x| of x's tokens, so with
   any global token order, all but the last s|x| - k tokens of x hold at least k of
   the shared ones. k is a tenth of the set: a pair that only shares a passage
   falls short of k shared prefix tokens. The order puts tokens that occur in many
   documents last (those of the HOT_ROWS most frequent tokens, a table of bounded size),
   so common passages hardly enter prefixes.
3. Classes that share prefix tokens are first compared with one leader each, the
   document with the least tokens of its own among those that they meet most often, and
   once more among those that found none; exact verification of these pairs and
   connected components give groups of similar documents.
4. The token-group matrix holds each group's union of prefix tokens. Tokens that the
   same documents have, as those of a passage, are one class with a weight, so that a shared passage
   costs a few rows and not one for each token. A document looks for groups by its prefix tokens without
   the k - 1 most frequent, among theirs less the most frequent likewise, and its overlap with a
   group's union bounds its overlap with each member, so only groups with at least k of its
   tokens are opened; their members that share k prefix tokens are verified exactly. Tokens that a document has alone lower the
   bound on both sides: two edited copies of one original, each with its own edits,
   are told apart by counts. Groups that no document can enter from outside are
   never opened, so a large group of copies costs one comparison a document.

Every pair of two groups that could reach the threshold is verified, and all pairs
within a group are linked through it already: the components are exact.

Defined results: null, empty and wordless texts have an empty set and are linked
with nothing, themselves excepted. A text of fewer than n words is one shingle.
Rows of equal doc_id are one document of which the largest set counts (among sets of
one size, the one of the largest sums), in the component of which all its rows are. A null
doc_id is left out of links and returned as its own null component. Extra columns
are ignored by `components` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.components import connected
from tarnfield.llm.shared import WORK, fresh, mix, shingle_sets, stored, stored_alone, tidy, words

#: Common are the most frequent tokens that so many documents have, at most so many tokens: a table of fixed
#: size, whatever the input. It decides the order of tokens, not what is compared.
HOT_LEAST, HOT_ROWS = 8, 1_000_000
#: A task counts tokens in stretches of so many, and passes on those that a stretch has twice.
STRETCH = 4_000_000
K_SHARE = 10
#: Times that documents are compared with a leader each.
ROUNDS = 2
#: Ids that are sent to all tasks, at most.
BROADCAST_IDS = 500_000
S1, S2 = 0x51ED, 0xA2C3


def _sums(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """The first sum of each set; doc only rises."""
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(S1)), dtype=np.uint64)])
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    return (s[at[1:]] - s[at[:-1]]).view(np.int64)


def _sets(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, size and two sums of each set; and rows (token, times) of tokens that are frequent within a task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            held.clear()
            token, times = token[times > 1], times[times > 1]
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(token), pa.array(times)], names=names)

        for batch in batches:
            size, a, b = [], [], []
            for w in words(batch.column(1)):
                doc, h = shingle_sets(w, n)
                size.append(np.bincount(doc, minlength=w.n_docs))
                for out, salt in ((a, S1), (b, S2)):
                    s = np.zeros(w.n_docs, np.uint64)
                    np.add.at(s, doc, mix(h + np.uint64(salt)))
                    out.append(s.view(np.int64))
                held.append(h.view(np.int64))
                if sum(len(x) for x in held) > STRETCH:
                    yield counted()
            none = pa.nulls(len(batch), pa.int64())
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), cat(size), cat(a), cat(b), none, none], names=names)
        yield counted()

    names = ["doc_id", "size", "s1", "s2", "token", "times"]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, size long, s1 long, s2 long, token long, times long")


def prefix_sizes(size: np.ndarray, percent: int) -> np.ndarray:
    need = -(-percent * size // 100)
    return np.minimum(size, size - need + np.maximum(size // K_SHARE, 1))


def _prefixes(documents: DataFrame, n: int, percent: int, hot: np.ndarray, hot_rank: np.ndarray) -> DataFrame:
    """doc_id, size and the prefix tokens of every document; n_rare: how many of them are not common, full: whether it has no others that are not."""
    sent = documents.sparkSession.sparkContext.broadcast((hot, hot_rank))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, ranks = sent.value
        for batch in batches:
            for w in words(batch.column(1)):
                doc, h = shingle_sets(w, n)
                s1 = _sums(doc, h, w.n_docs)
                rank = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h.view(np.int64)), len(common) - 1)
                    rank = np.where(common[at] == h.view(np.int64), ranks[at], 0)
                    order = np.lexsort((h, rank, doc))
                    doc, h, rank = doc[order], h[order], rank[order]
                size = np.bincount(doc, minlength=w.n_docs)
                first = np.concatenate([[0], np.cumsum(size)])[:-1]
                keep = np.arange(len(doc)) - first[doc] < prefix_sizes(size, percent)[doc]
                rare = np.bincount(doc[rank == 0], minlength=w.n_docs)
                n_rare = np.bincount(doc[keep & (rank == 0)], minlength=w.n_docs)
                # the lowest bit tells whether a token is rare, the same for all documents
                h = (h & ~np.uint64(1)) | (rank == 0).astype(np.uint64)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=w.n_docs))])
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n_docs), pa.array(size), pa.array(s1), pa.array(n_rare), pa.array(rare == n_rare), tokens], names=["doc_id", "size", "s1", "n_rare", "full", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, size long, s1 long, n_rare long, full boolean, tokens array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets meet the threshold; texts whose set is not the one that counts are left out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                keys, sizes, sums = [], [], []
                for c in (2, 3):
                    docs, hs = [], []
                    size, s1 = [], []
                    for w in words(part.column(c)):
                        doc, h = shingle_sets(w, n)
                        docs.append(doc + w.first)
                        hs.append(h)
                        size.append(np.bincount(doc, minlength=w.n_docs))
                        s1.append(_sums(doc, h, w.n_docs))
                    sums.append(np.concatenate(s1) == part.column(c + 2).to_numpy())
                    keys.append((np.concatenate(docs), np.concatenate(hs)))
                    sizes.append(np.concatenate(size))
                doc, h = np.concatenate([keys[0][0], keys[1][0]]), np.concatenate([keys[0][1], keys[1][1]])
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
                inter = np.bincount(doc[1:][same], minlength=len(part))
                ok = (100 * inter >= percent * (sizes[0] + sizes[1] - inter)) & (inter > 0) & sums[0] & sums[1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok))

    pairs = stored(pairs.select("a", "b"), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # few ids go to the texts; many, and their texts, are dealt by id
    texts = texts.join(F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed.hint("shuffle_merge"), "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"), F.col("s1").alias("sa"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"), F.col("s1").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", "sa", "sb").mapInArrow(run, "a long, b long")


def _most(size_a: Column, own_a: Column, size_b: Column, own_b: Column) -> Column:
    """The largest intersection that two sizes and the tokens that either has alone allow."""
    return F.least(size_a - own_a, size_b - own_b)


def _least(size: Column, percent: int) -> Column:
    """How many tokens a set of this size shares at least with any partner, within the prefixes of both."""
    return F.greatest(F.floor(F.ceil(size * percent / 100) / K_SHARE), F.floor(size / K_SHARE) - 2, F.lit(1))


def _shared(of: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """How many tokens the prefix of a set of size `of`, one of the two, shares with the other set at the threshold.

    The set whose prefix ends first in the global order has all of it decided: what the other prefix lacks, the other set lacks.
    """
    overlap = F.ceil((size_a + size_b) * percent / (100 + percent))
    prefix = F.least(of, of - F.ceil(of * percent / 100) + F.greatest(F.floor(of / K_SHARE), F.lit(1)))
    return overlap - of + prefix


def _meets(tokens: DataFrame, rare: Column) -> DataFrame:
    """doc_id, token, n and t of the tokens (doc_id, token) that several documents have: how many, and the class of tokens.

    Rare tokens come dealt by token: nearly all are of one document, so that counting them before the shuffle would deal them twice, and
    none has many. Common ones are counted before the shuffle, and joins may split them.
    """
    about = [F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bit_xor("doc_id").alias("all_ids")]
    shared = tokens.groupBy("token").agg(*about).where("n > 1")
    return tokens.join(shared.select("token", "n", F.xxhash64("n", "first", "last", "all_ids", rare).alias("t")), "token")


def components(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; component_id is the smallest doc_id reachable by links."""
    since = len(WORK)
    all_rows = stored(_sets(documents, n), "sets")
    sets = all_rows.where("token is null").select("doc_id", "size", "s1", "s2")
    # the smallest id of each class; ids are pre-aggregated before the shuffle
    one = sets.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("size", "s1", "s2")).alias("x")).select("doc_id", "x.*")
    one = stored(one, "one")
    classes = stored(one.where("size > 0").groupBy("size", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    counts = stored(all_rows.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= HOT_LEAST), "counts")
    # how many tokens have each power of 2**(1/4): a few dozen rows
    step = F.floor(F.log2("times") * 4).cast("int")
    left, least_step = HOT_ROWS, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= r["count"]
        if left < 0:
            break
        least_step = r.step
    common = counts.where(step >= least_step) if least_step is not None else counts.limit(0)
    table = common.orderBy("token").toArrow()
    hot = table.column("token").to_numpy().astype(np.int64)
    rank = np.log2(np.maximum(table.column("times").to_numpy().astype(float), 1)).astype(np.int64) + 1
    prefixes = _prefixes(documents, n, percent, hot, rank).where("size > 0 and doc_id is not null")
    reps = classes.select(F.col("rep").alias("doc_id"), "size", "s1")
    # a representative has one class, which is compared after equal rows are dropped: else it is a key of the join, and rows are dealt twice
    own_class = reps.select("doc_id", F.col("size").alias("of_size"), F.col("s1").alias("of_s1"))
    prefixes = prefixes.join(own_class, "doc_id").dropDuplicates(["doc_id", "size", "s1"])
    prefixes = stored(prefixes.where((F.col("size") == F.col("of_size")) & (F.col("s1") == F.col("of_s1"))).drop("of_size", "of_s1"), "prefixes")
    facts = prefixes.select("doc_id", "size", "n_rare", "full")
    tokens = prefixes.select("doc_id", F.explode("tokens").alias("token"))
    # tokens that the same documents have are one class of tokens; documents that share a passage meet in its classes
    # (documents are told apart by how many, which first and last, and the xor of all: a chance likeness only adds candidates)
    rare = F.col("token").bitwiseAND(F.lit(1))
    meets = _meets(tokens.where(rare == 1).repartition("token"), rare).unionByName(_meets(tokens.where(rare == 0), rare))
    meets = stored(meets.groupBy("doc_id", "t").agg(F.count("*").alias("w"), F.sum(rare).alias("rare"), F.first("n").alias("n")), "meets")
    # too few shared prefix tokens for any partner
    least = _least(F.col("size"), percent)
    # tokens of its own: if all rare tokens are in the prefix, those that no other prefix has are in no such document
    own = F.when(F.col("full"), F.col("n_rare") - F.col("rare")).otherwise(0)
    alive = meets.groupBy("doc_id").agg(F.sum("w").alias("m"), F.sum("rare").alias("rare")).join(facts, "doc_id").withColumn("own", own)
    alive = alive.where((F.col("m") >= least) & (F.col("own") * 100 <= F.col("size") * (100 - percent))).select("doc_id", "size", "full", least.alias("k"), "own")
    meets = stored(meets.join(alive, "doc_id").select("doc_id", "size", "full", "k", "own", "t", "w", "n"), "alive")

    # A leader for each document, then again for those without a group: of the documents of a class, the one with the
    # least share of tokens of its own, as an original among edited copies has.
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").join(reps.select("doc_id", "s1"), "doc_id")
    edges, groups = None, None
    for _ in range(ROUNDS):
        alone = meets if groups is None else meets.join(groups.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
        share = F.struct(F.floor(F.col("own") * 1000 / F.col("size")).alias("own"), F.col("doc_id").alias("leader"))
        leaders = alone.groupBy("t").agg(F.min(share).alias("x"), F.count("*").alias("docs")).where("docs > 1").select("t", "x.leader")
        met = alone.join(leaders, "t").where("leader != doc_id").groupBy("doc_id", "leader").agg(F.sum("w").alias("m"))
        best = met.groupBy("doc_id").agg(F.max(F.struct("m", (-F.col("leader")).alias("l"))).alias("x")).select((-F.col("x.l")).alias("a"), F.col("doc_id").alias("b"))
        found = _verified(best, texts, n, percent)
        edges = stored(found if edges is None else edges.unionByName(found), "leader_edges")
        groups = connected(edges)

    # the token-group matrix, and the groups that a document can have a partner in
    placed = meets.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("g", F.coalesce("component", "doc_id"))
    placed = stored(placed.select("doc_id", "size", "full", "own", "k", "t", "w", "n", "g"), "placed")
    open_tokens = placed.groupBy("t").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("t")
    common_first = Window.partitionBy("doc_id").orderBy(F.desc("n"), "t").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored(placed.join(open_tokens, "t").withColumn("place", F.sum("w").over(common_first)), "open")
    # Tokens that the same groups hold are one class to the matrix, as token classes are to documents.
    held = placed.select("t", "g").distinct()
    alike = held.groupBy("t").agg(F.xxhash64(F.count("*"), F.min("g"), F.max("g"), F.bit_xor("g")).alias("u"))
    about = placed.groupBy("g").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("own").alias("to_own"), F.bool_and("full").alias("to_full"))
    matrix = stored(held.join(alike, "t").select(F.col("u").alias("to_u"), "g").distinct().join(about, "g").withColumnRenamed("g", "to"), "matrix")
    after = F.greatest(F.least(F.col("w"), F.col("place") - F.col("k") + 1), F.lit(0))
    of_doc = placed.join(alike, "t").groupBy("doc_id", "size", "full", "own", "k", "g", "u").agg(F.sum("w").alias("w"), F.sum(after).alias("after"))
    of_doc = stored(of_doc, "of_doc")
    both_full = F.col("full") & F.col("to_full")
    most = _most(F.col("size"), F.when(both_full, F.col("own")).otherwise(0), F.col("high"), F.when(both_full, F.col("to_own")).otherwise(0))
    nearest = F.greatest(F.col("low"), F.least(F.col("high"), most))
    reach = (100 * most >= percent * (F.col("size") + nearest - most)) & (F.col("high") * 100 >= F.col("size") * percent) & (F.col("low") * percent <= F.col("size") * 100)
    # A pair shares so many prefix tokens at least; the bound rises as sizes come closer. Of the sizes that the group's
    # members have, those within the threshold count; two less for rounding.
    low, high = F.greatest("low", F.ceil(F.col("size") * percent / 100)), F.least("high", F.floor(F.col("size") * 100 / percent))
    at_least = F.greatest(F.least(_shared(F.col("size"), F.col("size"), low, percent), _shared(high, F.col("size"), high, percent)) - 2, F.lit(1))
    # the k - 1 most frequent tokens are set aside, so as many of the shared ones at most are not looked up
    looked = F.greatest(at_least - F.greatest("k", _least(high, percent)) + 1, F.lit(1))
    facts_of = [F.first(c).alias(c) for c in ("size", "k", "low", "high")]
    asks_of = of_doc.where("after > 0")
    # A group of one is its member. Its row has all classes that it looks up, so that a pair is told apart at one of the classes
    # that it shares, the largest, and is one row.
    members = placed.groupBy("g").agg(F.countDistinct("doc_id").alias("members"))
    listed = stored(asks_of.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("u", "after"))).alias("looks")), "listed")
    one_row = asks_of.join(listed, "doc_id")
    single = one_row.join(members.where("members = 1").select("g"), "g").select(F.col("u").alias("to_u"), F.col("g").alias("to"), F.col("doc_id").alias("b"), F.col("size").alias("low"), F.col("size").alias("high"), F.col("own").alias("to_own"), F.col("full").alias("to_full"), F.col("looks").alias("to_looks"))
    common = F.array_intersect(F.map_keys("looks"), F.map_keys("to_looks"))
    told = F.aggregate(common, F.lit(0).cast("long"), lambda acc, x: acc + F.col("looks")[x])
    alone = one_row.join(single, (F.col("u") == F.col("to_u")) & (F.col("g") < F.col("to")) & reach & (F.array_max(common) == F.col("u")) & (told >= looked)).select(F.col("doc_id").alias("a"), "b")
    # the others are opened if their union of tokens allows it
    large = stored(matrix.join(members.where("members > 1").select(F.col("g").alias("to")), "to"), "large")
    met = asks_of.join(large, (F.col("u") == F.col("to_u")) & (F.col("g") < F.col("to")) & reach)
    several = stored(met.groupBy("doc_id", "to").agg(F.sum("after").alias("m"), *facts_of).where(F.col("m") >= looked).select("doc_id", F.col("to").alias("of")), "near")
    bound = of_doc.select("doc_id", "size", "k", "u", "w").join(several, "doc_id").join(large, (F.col("u") == F.col("to_u")) & (F.col("of") == F.col("to")))
    overlap = bound.groupBy("doc_id", "to").agg(F.sum("w").alias("m"), *facts_of)
    opened = stored(overlap.where(F.col("m") >= at_least).select("doc_id", "to"), "opened")
    asks = placed.where(F.col("place") >= F.col("k")).select("doc_id", "size", "full", "own", "t", "g", "place")
    mine = asks.select(F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("full").alias("full_a"), F.col("own").alias("own_a"), "t", F.col("place").alias("place_a")).join(opened.select(F.col("doc_id").alias("a"), F.col("to").alias("g_a")), "a")
    theirs = asks.select(F.col("doc_id").alias("b"), F.col("size").alias("size_b"), F.col("full").alias("full_b"), F.col("own").alias("own_b"), F.col("t").alias("to_t"), F.col("g").alias("to"), F.col("place").alias("place_b"))
    full = F.col("full_a") & F.col("full_b")
    inter = _most(F.col("size_a"), F.when(full, F.col("own_a")).otherwise(0), F.col("size_b"), F.when(full, F.col("own_b")).otherwise(0))
    a_, b_ = F.col("size_a"), F.col("size_b")
    pair_least = F.least(_shared(a_, a_, b_, percent), _shared(b_, a_, b_, percent))
    close = (100 * inter >= percent * (a_ + b_ - inter)) & (F.col("place_a") >= pair_least) & (F.col("place_b") >= pair_least)
    met = mine.join(theirs, (F.col("t") == F.col("to_t")) & (F.col("g_a") == F.col("to")) & close).select("a", "b").distinct()
    # of the documents that met, those that share enough of their prefixes for their sizes; a document's classes are one row
    lists = stored(placed.groupBy("doc_id", "size").agg(F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("held")), "lists")
    of_a, of_b = (lists.select(F.col("doc_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("held").alias(f"held_{x}")) for x in "ab")
    both = F.array_intersect(F.map_keys("held_a"), F.map_keys("held_b"))
    m = F.aggregate(both, F.lit(0).cast("long"), lambda acc, t: acc + F.col("held_a")[t])
    pairs = stored(met.unionByName(alone), "met").join(of_b, "b").join(of_a, "a").where(m >= pair_least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _verified(pairs, texts, n, percent)
    final = connected(stored(edges.unionByName(more), "all_edges"))

    ids = one.join(classes, ["size", "s1", "s2"], "left").select("doc_id", "rep")
    member = sets.where("doc_id is not null").join(ids, "doc_id").select("doc_id", "size", "rep")
    member = member.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    nulls = sets.where("doc_id is null").select("doc_id", F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return stored_alone(member.unionByName(nulls), "components", since)


def one_of_each(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """documents, with the columns they had, of which each group of near duplicates keeps its smallest doc_id."""
    id_ = fresh(documents, "kept_id")
    kept = components(documents, n, percent).where("component_id is null or component_id = doc_id").select(F.col("doc_id").alias(id_)).distinct()
    return documents.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
