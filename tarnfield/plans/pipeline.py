"""The declarative retrieval pipeline: a spec of stages, and the lazy plan that runs it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import parse_order, parse_queries, parse_rewrite
from tarnfield.operators import chunking, retrieval

#: A chunk's position is its document's id times this, plus its number in the document. A document of so many chunks, or an
#: id whose positions don't fit a long, is an error: positions never run into those of another document.
CHUNKS_A_DOCUMENT = 1 << 20


@dataclass(frozen=True)
class Chunker:
    kind: str = "words"  # words, fixed, structure, whole
    size: int = 64
    overlap: int = 0  # fixed: byte-pair tokens that a window shares with the one before
    embed_headings: bool = False  # structure: whether the heading path is searched with the text


@dataclass(frozen=True)
class Search:
    mode: str = "keyword"  # keyword, vector, hybrid
    depth: int = 20
    rrf_k: int = retrieval.RRF_K
    fuse_depth: int | None = None  # hybrid: how many of each ranking are fused; all if None


@dataclass(frozen=True)
class Filter:
    placement: str = "off"  # off, before, after
    access: bool = True
    status: bool = True


@dataclass(frozen=True)
class Rerank:
    mode: str = "passthrough"  # passthrough, scores (of a cross encoder), order (a model's reply)
    shortlist: int = 20


@dataclass(frozen=True)
class Prompt:
    k: int = 5
    order: str = "rank"  # rank, reverse, ends


@dataclass(frozen=True)
class Spec:
    chunker: Chunker = field(default_factory=Chunker)
    search: Search = field(default_factory=Search)
    filter: Filter = field(default_factory=Filter)
    rerank: Rerank = field(default_factory=Rerank)
    prompt: Prompt = field(default_factory=Prompt)
    rewrite: str = "passthrough"  # passthrough, rewrite, split, resolve_followup

    @property
    def config_id(self) -> str:
        """Twelve hexadecimal digits of the canonical JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]

    def changed(self, **blocks: dict) -> Spec:
        """The spec with some blocks overlaid; more than one changed stage is an error."""
        if unknown := set(blocks) - set(asdict(self)):
            raise ValueError(f"unknown stages: {sorted(unknown)}")
        if len(blocks) > 1:
            raise ValueError("a condition changes one stage")
        return replace(self, **{k: replace(getattr(self, k), **v) if isinstance(v, dict) else v for k, v in blocks.items()})


def _or(df: DataFrame, name: str, other: Column) -> Column:
    return F.col(name) if name in df.columns else other.alias(name)


def chunks_of(docs: DataFrame, c: Chunker) -> DataFrame:
    """pos, chunk_id, doc_id, start, stop, text, embed_text, headings, title, access, status.

    docs: doc_id, text, access, status, and doc_key and title if it has them. pos rises with doc_id and chunk; a
    whole document's is its id.
    """
    pieces = {
        "whole": lambda: chunking.whole(docs),
        "words": lambda: chunking.word_chunks(docs, c.size),
        "fixed": lambda: chunking.bpe_windows(docs, c.size, c.overlap),
        "structure": lambda: chunking.structure_chunks(docs, c.size),
    }[c.kind]()
    facts = ["access", "status", _or(docs, "title", F.lit("")), _or(docs, "doc_key", F.col("doc_id").cast("string"))]
    fits = (F.col("chunk_no") < CHUNKS_A_DOCUMENT) & F.col("doc_id").between(-((1 << 63) // CHUNKS_A_DOCUMENT), (1 << 63) // CHUNKS_A_DOCUMENT - 1)
    far = F.raise_error(F.concat(F.lit("no position for chunk "), F.col("chunk_no").cast("string"), F.lit(" of document "), F.col("doc_id").cast("string"))).cast("long")
    pos = F.col("doc_id") if c.kind == "whole" else F.when(fits, F.col("doc_id") * CHUNKS_A_DOCUMENT + F.col("chunk_no")).otherwise(far)
    if c.kind == "whole":  # texts stay where they lie
        chunks = docs.where("doc_id is not null").select("doc_id", F.lit(0).cast("long").alias("chunk_no"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("stop"), "text", *facts)
    elif "text" in pieces.columns:  # no body is repeated for its chunks
        chunks = pieces.join(docs.select("doc_id", *facts), "doc_id")
    else:
        chunks = pieces.join(docs.select("doc_id", F.col("text").alias("body"), *facts), "doc_id").withColumn("text", F.substring("body", F.col("start") + 1, F.col("stop") - F.col("start")))
    headings = _or(pieces, "headings", F.array().cast("array<string>"))
    chunks = chunks.select(pos.alias("pos"), F.concat("doc_key", F.lit("#"), F.col("chunk_no").cast("string")).alias("chunk_id"), "doc_id", "start", "stop", "text", headings, "title", "access", "status")
    path = F.concat(F.array_join("headings", " > "), F.lit("\n\n"), F.col("text"))
    embed = F.when(F.size("headings") > 0, path).otherwise(F.col("text")) if c.embed_headings else F.col("text")
    return chunks.withColumn("embed_text", embed)


def queries_of(items: DataFrame, spec: Spec, replies: DataFrame | None = None) -> DataFrame:
    """item_id, query_no, asker, text: what is searched for each item.

    replies (item_id, text) are a model's rewrites. Without one, and for an item without earlier turns in
    resolve_followup, the question is searched as typed; split then splits it at full stops.
    """
    if spec.rewrite == "passthrough" or (replies is None and spec.rewrite != "split"):
        return items.select("item_id", "asker", F.lit(0).alias("query_no"), F.col("question").alias("text"))
    question = F.col("question")
    if replies is None:
        reply = F.replace(question, F.lit(". "), F.lit("\n"))
        told = items.select("item_id", "asker", "question", reply.alias("reply"))
    else:
        asked = items.select("item_id", "asker", "question", _or(items, "history", F.lit("")))
        told = asked.join(replies.select("item_id", F.col("text").alias("reply")), "item_id", "left")
        needs = F.coalesce(F.col("history"), F.lit("")) != "" if spec.rewrite == "resolve_followup" else F.lit(True)
        told = told.withColumn("reply", F.when(needs, F.col("reply")))
    reply = F.coalesce("reply", F.lit(""))
    parts = parse_queries(reply, question) if spec.rewrite == "split" else F.array(parse_rewrite(reply, question))
    return told.select("item_id", "asker", F.posexplode(parts).alias("query_no", "text"))


def _refused(f: Filter) -> Column:
    access = F.col("access") if f.access else F.lit("public")
    status = F.col("status") if f.status else F.lit("current")
    return retrieval.refusal(access, status, F.col("asker"))


def _searched(index: retrieval.KeywordIndex | None, q: DataFrame, light: DataFrame, s: Search, allowed: Column | None, vectors: DataFrame | None, query_vectors: DataFrame | None) -> DataFrame:
    """query_id, pos, score, rank of each query's best chunks by the spec's search."""
    deep = s.depth if s.mode != "hybrid" else s.fuse_depth or retrieval.prefix(s.depth, s.rrf_k)
    texts, lists = q.select("query_id", "text", "asker"), []
    if index is not None:
        lists.append((index.top_k(texts, deep, allowed, light), lambda wanted: index.places(texts, wanted, allowed, light)))
    if s.mode in ("vector", "hybrid"):
        asks = query_vectors.select(F.struct(F.col("query_id").alias("item_id"), F.lit(0).alias("query_no")).alias("query_id"), "v").join(q.select("query_id", "asker"), "query_id")
        here = vectors.join(light.select("pos"), "pos")
        lists.append((retrieval.vector_top_k(asks, here, deep, allowed, light), lambda wanted: retrieval.vector_places(asks, here, wanted, allowed, light)))
    if len(lists) == 1:
        return lists[0][0]
    if s.fuse_depth is None:
        return retrieval.fuse_whole(lists, s.depth, s.rrf_k)
    both = lists[0][0].select("query_id", F.lit(1).alias("list_no"), "rank", "pos").unionByName(lists[1][0].select("query_id", F.lit(2).alias("list_no"), "rank", "pos"))
    return retrieval.fuse(both, s.rrf_k).where(F.col("rank") <= s.depth)


def _reranked(kept: DataFrame, chunks: DataFrame, r: Rerank, scores: DataFrame | None, orders: DataFrame | None) -> DataFrame:
    """kept with the first `shortlist` of each item in a new order: by a score, highest first, or as a reply names them."""
    if r.mode == "passthrough" or (scores if r.mode == "scores" else orders) is None:
        return kept
    by_item = Window.partitionBy("query_id")
    kept = kept.withColumn("short", F.col("rank") <= r.shortlist)
    if r.mode == "scores":
        kept = kept.join(scores.select(F.col("item_id").alias("query_id"), "pos", F.col("score").alias("model")), ["query_id", "pos"], "left")
        place = F.when(F.col("short"), -F.coalesce("model", F.lit(float("-inf")))).otherwise(F.lit(float("inf")))
        return kept.withColumn("rank", F.row_number().over(by_item.orderBy(place, "rank"))).drop("short", "model")
    n = kept.groupBy("query_id").agg(F.count_if("short").cast("int").alias("n"))
    named = n.join(orders.select(F.col("item_id").alias("query_id"), F.col("text").alias("reply")), "query_id").select("query_id", F.posexplode(parse_order(F.col("reply"), F.col("n"))).alias("place", "was"))
    kept = kept.join(named.select("query_id", "place", (F.col("was") + 1).alias("rank")), ["query_id", "rank"], "left")
    return kept.withColumn("rank", F.row_number().over(by_item.orderBy(F.col("place").isNull(), "place", "rank"))).select("query_id", "pos", "score", "rank")


def run(docs: DataFrame, items: DataFrame, spec: Spec, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, replies: DataFrame | None = None, scores: DataFrame | None = None, orders: DataFrame | None = None, index: retrieval.KeywordIndex | None = None, chunks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the stages: `chunks`; `queries`; `searched`, `removed` (with the reason: chunks that a filter after the search
    takes out, or that one before it kept out of what an unfiltered search finds), `filtered`, `ranked` and `prompt`, each
    by query_id = item and pos; `texts`, the prompt of each item. Only a stated query set, term weights and the best chunks of a keyword search are computed at once.

    docs: as chunks_of. items: item_id, question, asker, and history if there are earlier turns. vectors: pos, v.
    query_vectors: query_id, v. replies: a rewriting model's (item_id, text). scores: a cross encoder's (item_id, pos, score).
    orders: a reranking model's replies (item_id, text), whose numbers begin at 1. chunks and
    index: of the same documents by the spec's chunker, if they are at hand.
    """
    s, f = spec.search, spec.filter
    if s.mode != "keyword" and (vectors is None or query_vectors is None):
        raise ValueError("vector search needs vectors")
    chunks = chunks_of(docs, spec.chunker) if chunks is None else chunks
    q = queries_of(items, spec, replies).withColumn("query_id", F.struct("item_id", "query_no"))
    light = chunks.select("pos", "access", "status")
    # statistics are of all chunks, whoever asks
    if s.mode != "vector":
        index = index or retrieval.KeywordIndex(chunks.select("pos", F.col("embed_text").alias("text")))
    else:
        index = None
    allowed = _refused(f).isNull() if f.placement == "before" else None
    found = _searched(index, q, light, s, allowed, vectors, query_vectors)
    flat = found.select(F.col("query_id.item_id").alias("query_id"), F.col("query_id.query_no").alias("list_no"), "rank", "pos", "score")
    # several queries of an item are fused again, with the usual constant
    searched = retrieval.fuse(flat.drop("score")) if spec.rewrite == "split" else flat.drop("list_no")
    searched = searched.where(F.col("rank") <= s.depth)
    asker = items.select(F.col("item_id").alias("query_id"), "asker")
    filtered, looked = searched, searched
    if f.placement == "after":
        kept = searched.join(light, "pos").join(asker, "query_id").where(_refused(f).isNull()).select("query_id", "pos", "score", "rank")
        filtered = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    elif f.placement == "before":
        first = _searched(index, q.where("query_no = 0"), light, s, None, vectors, query_vectors)
        looked = first.select(F.col("query_id.item_id").alias("query_id"), "pos", "score", "rank")
    reasons = looked.join(light, "pos").join(asker, "query_id").withColumn("reason", _refused(f) if f.placement != "off" else F.lit(None).cast("string"))
    removed = reasons.where("reason is not null").select("query_id", "pos", "rank", "reason")
    ranked = _reranked(filtered, chunks, spec.rerank, scores, orders)
    top = ranked.where(F.col("rank") <= spec.prompt.k).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    place = {"rank": F.col("rank"), "reverse": -F.col("rank"), "ends": retrieval.ends_order(F.col("rank"), F.col("n"))}[spec.prompt.order]
    prompt = top.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(place))).drop("n")
    return {"chunks": chunks, "queries": q, "searched": searched, "removed": removed, "filtered": filtered, "ranked": ranked, "prompt": prompt, "texts": prompt_texts(prompt, chunks, items)}


def prompt_texts(prompt: DataFrame, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, prompt: numbered passages with their titles, any earlier turns, and the question last; an item without passages has the question."""
    block = F.concat(F.lit("[P"), F.col("place").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.btrim("text", F.lit(" \t\n\r")))
    texts = prompt.join(chunks.select("pos", "title", "text"), "pos").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("b"))
    asked = items.select(F.col("item_id").alias("query_id"), "question", _or(items, "history", F.lit(None).cast("string"))).join(texts, "query_id", "left")
    blocks = F.coalesce(F.transform("b", lambda x: x["block"]), F.array().cast("array<string>"))
    parts = F.concat(F.array(F.lit("Passages:")), blocks, F.array(F.nullif("history", F.lit("")), F.concat(F.lit("Question: "), F.col("question"))))
    return asked.select("query_id", F.array_join(parts, "\n\n").alias("prompt"))
