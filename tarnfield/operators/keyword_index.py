"""An inverted index of chunks as tables, and keyword search that opens only blocks that can matter.

Chunks are dealt into blocks of about BLOCK_ROWS by a hash of their position. The table of postings
has a row for each term and block: the chunks with the term, its frequencies there, and the largest frequency and least
length, which bound what the term can add to a score. It is partitioned by a hash of the term and sorted by term, so a search
reads the terms that were asked for and columns it needs.

A search adds up, for each query and block, what its terms can give at most. Each query's most promising blocks
are scored first; the k-th score found is a bound, and of the other blocks only those that can reach it are
opened. A block is scored in one task for all queries that open it, by sums over the entries of their terms: nothing
of the size of terms x queries, or of chunks x queries, is made anywhere. Queries stay a table, in blocks of
QUERY_ROWS; terms of up to QUERY_ROWS queries, SENT_TERMS at most, are sent to the tasks. Every chunk has a score, 0 where no term reaches it; queries whose k-th score is 0 open all blocks.

An index that is neither saved nor loaded is not written for queries that can be sent to the tasks: the texts are split once, where
they lie, into the frequencies of asked terms and the document frequencies of all terms; then every task scores its chunks for all
queries and keeps each query's best, so that texts, postings and hits are dealt nowhere.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import words
from tarnfield.operators.ranking import PLACES, QUERY_ROWS, Before, Best, before, best, kinds_of, permitted, query_block, query_key, query_of, top_k, visible
from tarnfield.session import work_dir, written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks of a block, about; terms are dealt into so many files at least.
BLOCK_ROWS, BUCKETS = 512, 16
#: The term that stands for the chunks of a block themselves; words are never empty.
MEMBERS = ""
#: What rounding can add to a score.
SLACK = 1e-6
#: An index of so few blocks is scored whole: bounds would cost more than they save.
FEW_BLOCKS = 32
#: Terms of at most QUERY_ROWS queries that are sent to all tasks.
SENT_TERMS = 1 << 18
#: Where texts are scanned: queries x chunks scored at a time, hits added up at a time, and terms of a task before they are summed.
CELLS, HITS, SEEN_ROWS = 1 << 18, 1 << 21, 1 << 20
#: A row for each chunk (its length, and the asked terms in it by number), and rows of a task's terms.
ENTRIES = "pos long, dl int, code array<int>, tf array<int>, term string, df long"


def _packed(chunks: pa.Table) -> pa.Table:
    """The postings of one block: a row for each term, with the chunks (by their place in the block) and frequencies, and a row of the chunks."""
    order = np.argsort(_one(chunks, "pos").to_numpy(), kind="stable")
    chunks = chunks.take(pa.array(order))
    pos, lists = _one(chunks, "pos"), _one(chunks, "terms")
    dl = lists.value_lengths().to_numpy().astype(np.int32)
    coded = lists.flatten().dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy() * np.int64(len(pos)) + np.repeat(np.arange(len(pos)), dl), return_counts=True)
    code, at = np.divmod(key, max(len(pos), 1))
    edge = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
    most, least = (np.append(f.reduceat(x, edge[:-1]) if len(code) else [], 0) for f, x in ((np.maximum, tf), (np.minimum, dl[at])))
    # the last row is the chunks'
    bounds = np.append(edge, len(code) + len(pos)).astype(np.int32)
    of = lambda x, y, kind: pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.append(x, y).astype(kind)))
    size = len(edge)
    chunk_pos = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(size, np.int32), len(pos)).astype(np.int32)), pos.cast(pa.int64()))
    term = pa.concat_arrays([coded.dictionary.take(pa.array(code[edge[:-1]])).cast(pa.string()), pa.array([MEMBERS])])
    columns = [term, pa.array(np.full(size, chunks.column("block")[0].as_py(), np.int32)), of(at, np.arange(len(pos)), np.int32), of(tf, dl, np.int32), chunk_pos, pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32))]
    return pa.table(columns, schema=PACKED)


PACKED = pa.schema([("term", pa.string()), ("block", pa.int32()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("pos", pa.list_(pa.int64())), ("most", pa.int32()), ("least", pa.int32())])


class KeywordIndex:
    """Postings and statistics of a chunk table (pos, text), written once, when first asked for, and scores by them."""

    def __init__(self, chunks: DataFrame):
        self.spark, self.chunks = chunks.sparkSession, chunks
        self.tallies: dict[str, tuple[DataFrame, float, dict[str, float]]] = {}

    @cached_property
    def path(self) -> str:
        path = f"{work_dir(self.spark)}/index-{uuid.uuid4().hex}"
        self._build(path)
        return path

    def _build(self, path: str) -> None:
        n = self.chunks.count()
        buckets = max(BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        block = F.pmod(F.xxhash64("pos"), F.lit(max(1, -(-n // BLOCK_ROWS)))).cast("int")
        # texts are dealt, then split where their block is packed
        dealt = self.chunks.select("pos", "text", block.alias("block")).repartition("block")
        split = dealt.select("pos", "block", words(F.coalesce("text", F.lit(""))).alias("terms"))
        rows = split.groupBy("block").applyInArrow(_packed, "term string, block int, at array<int>, tf array<int>, pos array<long>, most int, least int")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        postings = self.spark.read.parquet(f"{path}/postings")
        own = F.col("term") == MEMBERS
        tokens = postings.where(own).agg(F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")).first().tokens or 0
        postings.where(~own).groupBy("term").agg(F.sum(F.size("at")).alias("df")).write.parquet(f"{path}/df")
        mean = self.spark.read.parquet(f"{path}/df").agg(F.avg(self._raw(n)).alias("mean")).first().mean or 0.0
        totals = [(n, float(tokens / max(n, 1) or 1.0), float(mean), buckets)]
        self.spark.createDataFrame(totals, "n long, avgdl double, mean double, buckets int").write.parquet(f"{path}/totals")

    def save(self, path: str) -> None:
        """Writes the index to a path, from which later sessions load it."""
        if "path" not in self.__dict__:
            self._build(path)
            self.path = path
            return
        for name in ("postings", "df", "totals"):
            table = self.spark.read.parquet(f"{self.path}/{name}")
            (table.write.partitionBy("bucket") if name == "postings" else table.write).mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KeywordIndex:
        index = cls.__new__(cls)
        index.spark, index.path = spark, path
        return index

    @cached_property
    def totals(self) -> tuple[int, float, float, int]:
        """The number of chunks, their mean length, the mean of all terms' raw idf, and the number of term buckets."""
        return tuple(self.spark.read.parquet(f"{self.path}/totals").first())

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def blocks(self) -> int:
        return max(1, -(-self.totals[0] // BLOCK_ROWS))

    @staticmethod
    def _raw(n: int) -> Column:
        return F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)

    @staticmethod
    def _impact(tf, dl, avgdl: float):
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    def idf(self) -> DataFrame:
        """term, idf (Okapi): terms in more than half of all chunks get a share of the mean idf instead of a negative one."""
        n, _, mean, _ = self.totals
        raw = self._raw(n)
        return self.spark.read.parquet(f"{self.path}/df").select("term", F.when(raw < 0, EPSILON * mean).otherwise(raw).alias("idf"))

    def tallied(self, terms: pa.Array) -> tuple[DataFrame, float, dict[str, float]]:
        """Chunks with the frequencies of stated terms (by number), the mean length of chunks, and the terms' idf, of one reading of the texts."""
        key = hashlib.sha256("\n".join(terms.to_pylist()).encode()).hexdigest()
        if key not in self.tallies:
            sent = self.spark.sparkContext.broadcast(terms)
            split = self.chunks.select("pos", words(F.coalesce("text", F.lit(""))).alias("terms"))
            table = written(split.mapInArrow(lambda batches: _entries(batches, sent.value), ENTRIES))
            n, tokens = table.where("dl is not null").agg(F.count("*"), F.sum("dl")).first()
            df = written(table.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")))
            mean, raw = df.agg(F.avg(self._raw(n))).first()[0] or 0.0, self._raw(n)
            wanted = F.broadcast(self.spark.createDataFrame(pa.table({"term": terms})))
            idf = df.join(wanted, "term").select("term", F.when(raw < 0, EPSILON * mean).otherwise(raw).alias("idf"))
            self.tallies[key] = table.where("dl is not null").select("pos", "dl", "code", "tf"), float((tokens or 0) / max(n, 1) or 1.0), {r.term: r.idf for r in idf.collect()}  # SENT_TERMS at most
        return self.tallies[key]

    def _scan(self, queries: DataFrame, allowed: Column | None, facts: DataFrame | None) -> _Scan | None:
        """The queries as they are sent to the tasks, if the index is not written and they are few enough."""
        if "path" in self.__dict__:
            return None
        keyed = queries.select(query_key(F.col("query_id")).alias("q"), "text")
        names = keyed.select("q").distinct().limit(QUERY_ROWS + 1).toArrow()
        if len(names) > QUERY_ROWS:
            return None
        terms = keyed.select("q", F.explode(words(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times")).limit(SENT_TERMS + 1).toArrow()
        return _Scan(self, queries, names, terms, allowed, facts) if len(terms) <= SENT_TERMS else None

    def asked(self, queries: DataFrame) -> DataFrame:
        """query_id, term, weight of each query's (query_id, text) terms that a chunk has; a repeated term counts again."""
        counted = queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        return counted.join(self.idf(), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """query_id, pos, score of the chunks that a query (query_id, text) reaches: each block is scored in one task, as in a search."""
        s = _Search(self, queries, None, None)
        return s.scored(s.everywhere(s.queries.select("q")), 0, "reached").select(query_of(F.col("q"), queries).alias("query_id"), "pos", "score")

    def top_k(self, queries: DataFrame, k: int, allowed: Column | None = None, facts: DataFrame | None = None) -> DataFrame:
        """query_id, pos, score, rank of each query's (query_id, text) best k chunks.

        allowed, if given, says of columns of queries and of facts (pos, ..) which chunks a query ranks.
        """
        if (scan := self._scan(queries, allowed, facts)) is not None:
            return scan.top_k(k)
        s = _Search(self, queries, allowed, facts)
        if self.blocks <= FEW_BLOCKS:
            return top_k(s.scored(s.everywhere(s.queries.select("q")), k).select(query_of(F.col("q"), queries).alias("query_id"), "pos", "score"), k)
        bounds = s.bounds()
        by_query = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
        seeds = s.stored(bounds.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= 1 + 4 * k // BLOCK_ROWS).select("q", "block"))
        first = s.stored(s.scored(seeds, k))
        found = top_k(first.withColumnRenamed("q", "query_id"), k).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("least"))
        known = s.queries.select("q").join(found, "q", "left")
        # a query whose k-th score is 0, or that has found fewer, ranks chunks that no term reaches
        every = s.everywhere(known.where(F.coalesce("least", F.lit(0.0)) <= 0).select("q"))
        some = bounds.join(known.where("least > 0"), "q").where(F.col("bound") + SLACK >= F.col("least")).select("q", "block")
        rest = every.unionByName(some).join(seeds, ["q", "block"], "left_anti")
        both = first.unionByName(s.scored(rest, k))
        return top_k(both.select(query_of(F.col("q"), queries).alias("query_id"), "pos", "score"), k)

    def places(self, queries: DataFrame, wanted: DataFrame, allowed: Column | None = None, facts: DataFrame | None = None) -> DataFrame:
        """query_id, pos, rank of wanted pairs (query_id, pos) in the query's ranking of all chunks, which is nowhere put in order."""
        if (scan := self._scan(queries, allowed, facts)) is not None and (found := scan.places(wanted)) is not None:
            return found
        s = _Search(self, queries, allowed, facts)
        pairs = wanted.select(query_key(F.col("query_id")).alias("q"), "pos", s.block_of(F.col("pos")).alias("block"))
        told = s.stored(s.scored(pairs.groupBy("q", "block").agg(F.collect_list(F.struct("pos", F.lit(0.0).alias("score"))).alias("want")), 0, "score"))
        lists = told.groupBy("q").agg(F.collect_list(F.struct("pos", "score")).alias("want"), F.min("score").alias("least"))
        if self.blocks <= FEW_BLOCKS:
            opened = s.everywhere(lists.select("q", "want"))
        else:
            some = s.bounds().join(lists.where("least > 0"), "q").where(F.col("bound") + SLACK >= F.col("least")).select("q", "want", "block")
            opened = s.everywhere(lists.where("least <= 0").select("q", "want")).unionByName(some)
        counted = s.scored(opened, 0, "before").groupBy("q", "pos").agg(F.sum("score").alias("n"))
        return told.select("q", "pos").join(counted, ["q", "pos"], "left").select(query_of(F.col("q"), queries).alias("query_id"), "pos", (F.coalesce("n", F.lit(0.0)) + 1).cast("int").alias("rank"))


class _Search:
    """One set of queries asked of an index: what they ask, as written tables, and blocks scored for them."""

    def __init__(self, index: KeywordIndex, queries: DataFrame, allowed: Column | None, facts: DataFrame | None):
        self.index, self.filtered = index, allowed is not None and facts is not None
        self.folder = f"{work_dir(index.spark)}/search-{uuid.uuid4().hex}"
        self.tables = 0
        about = queries.select(query_key(F.col("query_id")).alias("q")).distinct()
        if self.filtered:
            about = about.join(permitted(queries, facts, allowed), "q", "left")
            self.kinds = kinds_of(facts)
        else:
            about = about.withColumn("kinds", F.lit(None).cast("array<string>"))
        asked = index.asked(queries).select(query_key(F.col("query_id")).alias("q"), "term", "weight")
        # of a few blocks all are scored at once, and the queries are read once
        few = index.blocks <= FEW_BLOCKS
        self.queries, self.asked, self.few = about if few else self.stored(about), self.stored(asked), few
        self.n = queries.count()
        # terms of few queries are sent to the tasks; those of many are dealt to the blocks that their queries open
        self.sent = None
        if self.n <= QUERY_ROWS and self.asked.count() <= SENT_TERMS:
            self.sent = index.spark.sparkContext.broadcast(self.asked.select("q", "term", "weight").toArrow().combine_chunks())

    def stored(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.index.spark.read.schema(df.schema).parquet(path)

    def everywhere(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.index.blocks - 1))))

    def block_of(self, pos: Column) -> Column:
        return F.pmod(F.xxhash64(pos), F.lit(self.index.blocks)).cast("int")

    def bounds(self) -> DataFrame:
        """q, block, bound: the most that a chunk of the block can score."""
        tops = self.index.postings.select("term", "block", "most", "least")
        most = F.greatest("weight", F.lit(0.0)) * KeywordIndex._impact(F.col("most"), F.col("least"), self.index.totals[1])
        return self.stored(self.asked.join(tops, "term").groupBy("q", "block").agg(F.sum(most).alias("bound")))

    def scored(self, opened: DataFrame, k: int, give: str = "best") -> DataFrame:
        """q, pos, score of blocks that queries open (q, block): the best k there, or all that a term reaches; or with (.., want) the scores of wanted chunks, or how many chunks come before them."""
        blank = F.lit(None)
        opened = opened if "want" in opened.columns else opened.withColumn("want", blank.cast("array<struct<pos:long,score:double>>"))
        opened = opened.withColumn("qb", query_block(F.col("q"), self.n))
        heads = opened.join(self.queries, "q").select("block", "qb", "q", blank.cast("string").alias("term"), blank.cast("double").alias("weight"), "kinds", "want")
        terms = opened.join(self.asked, "q").select("block", "qb", "q", "term", "weight", blank.cast("array<string>").alias("kinds"), blank.cast("array<struct<pos:long,score:double>>").alias("want"))
        needed = self.asked.select("term").distinct().unionByName(self.index.spark.createDataFrame([(MEMBERS,)], "term string"))
        lists = self.index.postings.join(needed, "term", "left_semi").select("block", "term", "at", "tf", "pos", blank.cast("array<string>").alias("kinds"))
        if self.filtered:
            grouped = self.kinds.groupBy(self.block_of(F.col("pos")).alias("block")).agg(F.collect_list("pos").alias("pos"), F.collect_list("kind").alias("kinds"))
            no = blank.cast("array<int>")
            lists = lists.unionByName(grouped.select("block", blank.cast("string").alias("term"), no.alias("at"), no.alias("tf"), "pos", "kinds"))
        if self.few:
            left = lists.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(max(0, (self.n - 1) // QUERY_ROWS)))))
        else:
            left = lists.join(opened.select(F.col("block").alias("block"), F.col("qb").alias("qb")).distinct(), "block")
        avgdl, filtered, sent = self.index.totals[1], self.filtered, self.sent

        def run(entries: pa.Table, asks: pa.Table) -> pa.Table:
            if sent is not None and len(asks):
                asks = _with_terms(asks, sent.value)
            q, pos, score = _block(entries.combine_chunks(), asks.combine_chunks(), avgdl, filtered, k, give)
            return pa.table({"q": q, "pos": pos, "score": score}, schema=pa.schema([("q", pa.string()), ("pos", pa.int64()), ("score", pa.float64())]))

        cells = left.select("block", "qb", "term", "at", "tf", "pos", "kinds").groupBy("block", "qb").cogroup((heads if sent is not None else heads.unionByName(terms)).groupBy("block", "qb"))
        return cells.applyInArrow(run, "q string, pos long, score double")


def _entries(batches: Iterator[pa.RecordBatch], asked: pa.Array) -> Iterator[pa.RecordBatch]:
    """ENTRIES of chunks (pos, terms): a row for each, then the number of chunks with each term that the task has seen."""
    names, kinds = ("pos", "dl", "code", "tf", "term", "df"), (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.int64())
    seen = pa.table({"term": pa.array([], pa.string()), "df": pa.array([], pa.int64())})
    summed = lambda t: t.combine_chunks().group_by("term").aggregate([("df", "sum")]).rename_columns({"df_sum": "df"}).select(["term", "df"])
    held = 0
    for batch in batches:
        pos, lists = batch.column(0), batch.column(1)
        dl = lists.value_lengths().to_numpy().astype(np.int32)
        coded = lists.flatten().cast(pa.string()).dictionary_encode()
        size = np.int64(max(len(coded.dictionary), 1))
        key, tf = np.unique(np.repeat(np.arange(len(pos)), dl) * size + coded.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(key, size)
        seen = pa.concat_tables([seen, pa.table({"term": coded.dictionary, "df": pa.array(np.bincount(code, minlength=len(coded.dictionary)))})])
        if len(seen) > 2 * held + SEEN_ROWS:
            seen = summed(seen)
            held = len(seen)
        number = pc.index_in(coded.dictionary, value_set=asked).fill_null(-1).to_numpy()[code]
        use = number >= 0
        bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[use], minlength=len(pos)))]).astype(np.int32))
        of = lambda x, b=bounds: pa.ListArray.from_arrays(b, pa.array(x.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pos.cast(pa.int64()), pa.array(dl), of(number[use]), of(tf[use]), *(pa.nulls(len(pos), k) for k in kinds[4:])], names=names)
    for batch in summed(seen).to_batches(max_chunksize=1 << 16):
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(batch), k) for k in kinds[:4]), batch.column(0), batch.column(1)], names=names)


class _Asked:
    """What is sent to the tasks that scan: queries by number, and for each term those that ask for it, with their weights."""

    def __init__(self, names: list[str], q: np.ndarray, code: np.ndarray, weight: np.ndarray, terms: int, avgdl: float, may: list | None):
        order = np.argsort(code, kind="stable")
        self.names, self.q, self.weight, self.avgdl, self.may = names, q[order], weight[order], avgdl, may
        self.fan = np.bincount(code, minlength=terms)
        self.first = np.cumsum(self.fan) - self.fan

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, queries x chunks) of as many chunks (pos, dl, code, tf, and kind where queries may not rank all) at a time as CELLS and HITS hold."""
        pos, dl, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float), batch.column(4) if self.may is not None else None
        size, n = batch.column(2).value_lengths().to_numpy(), len(self.names)
        code, tf = (batch.column(i).flatten().to_numpy() for i in (2, 3))
        row = np.repeat(np.arange(len(pos)), size)
        part, fan, end = KeywordIndex._impact(tf.astype(float), dl[row], self.avgdl), self.fan[code], np.concatenate([[0], np.cumsum(size)])
        hits = np.concatenate([[0], np.cumsum(fan)])[end]
        a = 0
        while a < len(pos):
            b = max(a + 1, min(a + max(1, CELLS // max(n, 1)), int(np.searchsorted(hits, hits[a] + HITS, "right")) - 1, len(pos)))
            own = slice(end[a], end[b])
            each = fan[own]
            at = np.arange(each.sum()) + np.repeat(self.first[code[own]] - (np.cumsum(each) - each), each)
            cell = self.q[at] * np.int64(b - a) + np.repeat(row[own] - a, each)
            s = np.round(np.bincount(cell, self.weight[at] * np.repeat(part[own], each), n * (b - a)).reshape(n, b - a), PLACES)
            yield pos[a:b], s if kind is None else np.where(visible(kind.slice(a, b - a), self.may, b - a), s, -np.inf)
            a = b


class _Told:
    """The scores of wanted pairs."""

    def __init__(self, q: np.ndarray, pos: np.ndarray):
        order = np.argsort(pos, kind="stable")
        self.q, self.pos, self.parts = q[order], pos[order], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, pos: np.ndarray, scores: np.ndarray) -> None:
        a, b = np.searchsorted(self.pos, pos, "left"), np.searchsorted(self.pos, pos, "right")
        at = np.repeat(np.arange(len(pos)), b - a)
        pair = np.arange(len(at)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
        self.parts.append((self.q[pair], pos[at], scores[self.q[pair], at]))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))


class _Scan:
    """A set of queries that is sent to the tasks, asked of chunks whose index is not written."""

    def __init__(self, index: KeywordIndex, queries: DataFrame, names: pa.Table, terms: pa.Table, allowed: Column | None, facts: DataFrame | None):
        self.index, self.queries = index, queries
        self.names = sorted(names.column("q").to_pylist())
        coded = pa.array(sorted(set(terms.column("term").to_pylist())), pa.string())
        self.chunks, avgdl, idf = index.tallied(coded)
        q, code = (pc.index_in(terms.column(c).cast(pa.string()), value_set=x).to_numpy().astype(np.int64) for c, x in (("q", pa.array(self.names, pa.string())), ("term", coded)))
        weight = terms.column("times").to_numpy() * np.array([idf.get(t, 0.0) for t in coded.to_pylist()])[code]
        may = None
        if allowed is not None and facts is not None:
            seen = dict(zip(*permitted(queries, facts, allowed).toArrow().to_pydict().values(), strict=True))  # QUERY_ROWS at most
            may = [seen.get(q) for q in self.names]
            self.chunks = self.chunks.join(kinds_of(facts), "pos", "left").select("pos", "dl", "code", "tf", "kind")
        self.sent = index.spark.sparkContext.broadcast(_Asked(self.names, q, code, weight, len(coded), avgdl, may))

    def over(self, make: Callable[[], object], only: np.ndarray | None = None) -> DataFrame:
        """query_id, pos, score that make().rows() gives of the chunks of each task, or of those whose (sorted) positions are stated."""
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, keep = sent.value, make()
            for batch in batches:
                part = batch if only is None else batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), only)))
                for pos, scores in asked.scores(part):
                    keep.add(pos, scores)
            q, pos, score = keep.rows()
            yield pa.RecordBatch.from_arrays([pa.array(asked.names, pa.string()).take(pa.array(q, pa.int64())), pa.array(pos, pa.int64()), pa.array(score, pa.float64())], names=["q", "pos", "score"])

        found = self.chunks.mapInArrow(run, "q string, pos long, score double")
        return found.select(query_of(F.col("q"), self.queries).alias("query_id"), "q", "pos", "score")

    def top_k(self, k: int) -> DataFrame:
        # k rows a query, which several steps read
        return written(top_k(self.over(lambda: Best(k)).drop("q"), k))

    def places(self, wanted: DataFrame) -> DataFrame | None:
        pairs = wanted.select(query_key(F.col("query_id")).alias("q"), "pos").distinct().limit(SENT_TERMS + 1).toArrow()
        if len(pairs) > SENT_TERMS:
            return None
        names = pa.array(self.names, pa.string())
        pairs = pairs.filter(pc.is_in(pairs.column("q").cast(pa.string()), value_set=names))
        number = lambda t: pc.index_in(t.column("q").cast(pa.string()), value_set=names).to_numpy().astype(np.int64)
        q, pos = number(pairs), pairs.column("pos").to_numpy()
        told = self.over(lambda: _Told(q, pos), np.unique(pos)).where(F.col("score") > float("-inf")).select("q", "pos", "score").toArrow()  # SENT_TERMS at most
        tq, tpos, tscore = number(told), told.column("pos").to_numpy(), told.column("score").to_numpy()
        counted = self.over(lambda: Before(tq, tpos, tscore))
        return written(counted.groupBy("query_id", "pos").agg((F.sum("score") + 1).cast("int").alias("rank")))


def _with_terms(heads: pa.Table, asked: pa.Table) -> pa.Table:
    """The queries that open a block, with their terms."""
    own = asked.filter(pc.is_in(asked.column("q"), value_set=_one(heads, "q").cast(asked.schema.field("q").type)))
    columns = [own.column(f.name).cast(f.type) if f.name in own.column_names else pa.nulls(len(own), f.type) for f in heads.schema]
    return pa.concat_tables([heads, pa.table(columns, schema=pa.schema([pa.field(f.name, f.type) for f in heads.schema]))])


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def _block(entries: pa.Table, asks: pa.Table, avgdl: float, filtered: bool, k: int, give: str) -> tuple:
    """Scores of one block for the queries that open it."""
    none = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0)
    if not len(entries) or not len(asks):
        return none
    terms = _one(entries, "term").to_pylist()
    own, lists = terms.index(MEMBERS), _one(entries, "at")
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
    at, tf = lists.flatten().to_numpy(), _one(entries, "tf").flatten().to_numpy()
    members, lengths = np.array(_one(entries, "pos")[own].values), tf[bounds[own] : bounds[own + 1]]
    # queries, and for each of their terms the list of entries
    term, q = _one(asks, "term"), _one(asks, "q").dictionary_encode()
    names, q_of = q.dictionary, q.indices.to_numpy()
    head = term.is_null().to_numpy(zero_copy_only=False)
    number = {t: i for i, t in enumerate(terms) if t}
    listed = np.array([number.get(t, -1) for t in term.to_pylist()], int)
    use = np.flatnonzero(listed >= 0)
    first, size = bounds[listed[use]], bounds[listed[use] + 1] - bounds[listed[use]]
    flat_at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
    tf, at = tf[flat_at].astype(float), at[flat_at]
    dl = lengths[at]
    part = np.repeat(_one(asks, "weight").to_numpy(zero_copy_only=False)[use], size) * KeywordIndex._impact(tf, dl, avgdl)
    cell = np.repeat(q_of[use], size) * np.int64(len(members)) + at
    scores = np.round(np.bincount(cell, part, len(names) * len(members)).reshape(len(names), len(members)), PLACES)
    heads = np.flatnonzero(head)
    if filtered:
        kind: dict[int, str] = {}
        for i, t in enumerate(terms):
            if t is None:
                kind.update(zip(_one(entries, "pos")[i].as_py(), _one(entries, "kinds")[i].as_py(), strict=True))
        may: list = [None] * len(names)
        for i, seen in zip(q_of[heads].tolist(), _one(asks, "kinds").take(pa.array(heads)).to_pylist(), strict=True):
            may[i] = seen
        scores = np.where(visible(pa.array([kind.get(p) for p in members.tolist()], pa.string()), may, len(members)), scores, -np.inf)
    if give == "reached":
        found = np.unique(cell)
        row, place = np.divmod(found, max(len(members), 1))
        return names.take(pa.array(row)), members[place], scores.ravel()[found]
    if give == "best":
        row, pos, score = best(scores, members, k)
        return names.take(pa.array(row)), pos, score
    want = _one(asks, "want").take(pa.array(heads))
    row = np.repeat(q_of[heads], want.value_lengths().fill_null(0).to_numpy())
    pos, score = (want.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
    if give == "score":
        return names.take(pa.array(row)), pos, scores[row, np.searchsorted(members, pos)]
    return names.take(pa.array(row)), pos, before(scores, members, row, pos, score).astype(float)
