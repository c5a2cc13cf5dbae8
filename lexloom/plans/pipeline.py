"""The document pipeline: clean, gate, detect, chunk, summarise, dedup, merge and score, as a table of events."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import detect, metrics
from lexloom.functions import normalize as N
from lexloom.functions import predicates as P
from lexloom.functions import text as T
from lexloom.operators import chunking, lines, models, sparse, structure, vectors
from lexloom.operators.asking import in_order

PARALLEL_OVER, SEQUENTIAL_CAP = 4, 8000
EVENTS = ("doc_detected", "summary_start", "chunk_summary", "final", "error")


def greedy(texts: list[str], embed, threshold: float = vectors.DEDUP_THRESHOLD) -> list[str]:
    """Texts that are not too near to an earlier one that stayed."""
    if len(texts) < 2:
        return texts
    v = embed(texts)
    norm = np.linalg.norm(v, axis=1)
    unit = v / np.where(norm == 0, 1, norm)[:, None]
    stay: list[int] = []
    for i in range(len(texts)):
        if not stay or float((unit[stay] @ unit[i]).max()) <= threshold:
            stay.append(i)
    return [texts[i] for i in stay]


def dedup_texts(texts: Column, threshold: float = vectors.DEDUP_THRESHOLD, make=models.hashing_embedder) -> Column:
    """greedy() of each array; nulls go."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        embed = make()
        return rows.map(lambda xs: greedy([] if xs is None else [x for x in xs if x is not None], embed, threshold))

    return run(texts)


def runs(rows: pa.ListArray, most: int = 256, size: int = 1_000_000) -> Iterator[list[list[str] | None]]:
    """The arrays of texts of a batch in runs of so many rows and bytes at most; a longer row is a run of its own."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(rows.values), 0).to_numpy(zero_copy_only=False))])
    sizes = np.diff(ends[rows.offsets.to_numpy()]).tolist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin >= most or total + n > size):
            yield rows.slice(begin, i - begin).to_pylist()
            begin, total = i, 0
        total += n
    if begin < len(rows):
        yield rows.slice(begin).to_pylist()


def condensed(chunks: Column, backend: models.Backend | None = None, make=models.hashing_embedder, workers: int = 1) -> Column:
    """struct<summaries, good, merged, seconds> of an ordered array of chunk texts: a summary each (null where there
    is none), how many count, and the merged one of those that are not too near to an earlier one.

    workers: requests that a task has open at once. The chunks of a run of documents are asked in one go, whichever
    document they are of; merging is serial within a document, and so many documents are merged at once. seconds: those of
    the run, in equal parts. A run is bounded in rows and bytes, and besides it a task holds one Arrow batch.
    """
    used = backend or models.ExtractiveBackend()
    kind = pa.struct([("summaries", pa.list_(pa.string())), ("good", pa.int32()), ("merged", pa.string()), ("seconds", pa.float64())])

    @F.arrow_udf("struct<summaries:array<string>,good:int,merged:string,seconds:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = make()
        for rows in batches:
            if not len(rows):
                yield pa.array([], kind)
            for part in runs(rows):
                began = time.perf_counter()
                all_ = [cs or [] for cs in part]
                capped = [c if len(cs) > PARALLEL_OVER else c[:SEQUENTIAL_CAP] for cs in all_ for c in cs]
                answers = in_order(lambda c: models.summarise_chunk(c, used), capped, workers)
                said = [[next(answers) for _ in cs] for cs in all_]
                next(answers, None)  # ends its threads
                good = [[s for s in of if s and len(s.strip()) > models.KEEP_SUMMARY] for of in said]
                merged = list(in_order(lambda texts: models.merge(texts, used), [greedy(g, embed) for g in good], workers))
                share = (time.perf_counter() - began) / len(all_)
                columns = [said, [len(g) for g in good], merged, [share] * len(all_)]
                yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))

    return run(chunks)


def text_cosine(a: Column, b: Column) -> Column:
    """Cosine of the signed word counts of two texts, 0 where one has no words: sparse.cosine() of sparse.hashed(), which
    takes microseconds a word. The counts are whole numbers, so both find the same; Spark makes lower case of the texts.
    """

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        count = models.hashed_counts(sparse.DIM)
        for one, other in batches:
            found = []
            for at in range(0, len(one), 256):
                x, y = (count(texts.slice(at, 256).to_pylist()) for texts in (one, other))
                norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                found.append(np.where(norm == 0, 0.0, (x * y).sum(axis=1) / np.where(norm == 0, 1, norm)))
            yield pa.array(np.concatenate(found) if found else [], pa.float64())

    return run(F.lower(a), F.lower(b))


def gated(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with clean and passes (whether the clean text has a hundred characters)."""
    return lines.clean_documents(docs, text).withColumn("passes", P.long_enough(F.col("clean")))


def with_chunks(ready: DataFrame, quality: str = "Balanced") -> DataFrame:
    """ready (clean, passes) with words, max_tokens, and chunks: the valid ones of texts that pass, in order."""
    found = T.let(chunking.chunk_or_head(F.col("clean")), lambda c: F.filter(c, lambda x: P.valid_chunk(x["text"])))
    texts = F.transform(found, lambda c: c["text"])
    return ready.withColumns(
        {
            "words": T.count_tokens(F.col("clean")),
            "max_tokens": chunking.chunk_config(F.lit(quality), F.length("clean")),
            "chunks": T.settled(F.when(F.col("passes"), texts).otherwise(F.array().cast("array<string>"))),
        }
    )


FAILED = "[Failed]"


def run_pipeline(docs: DataFrame, doc: str = "doc_id", text: str = "text", backend: models.Backend | None = None, quality: str = "Balanced", chunk_overlap: int = chunking.OVERLAP, workers: int = 1) -> DataFrame:
    """Events (doc, seq, type, doc_type, confidence, words, detection, total_chunks, max_tokens, chunk_id, is_last, summary,
    chunks_summarized, compression, metrics, seconds, message) of every document.

    In order: doc_detected, summary_start, a chunk_summary for each valid chunk ([Failed] where the backend gave
    none), final; or one error for a document that is too short. A document without a valid chunk still gets its
    final event. seconds: what its summaries took. A null text is an empty one. Nothing is joined, gathered or
    shuffled: each row's events come from that row alone, so rows with a null or a repeated id are documents of
    their own, each with all its events.

    quality sets max_tokens, chunk_overlap the sentences that chunks share. The chunker's cleaning leaves groups
    of one sentence, which are never cut and overlap nothing, so neither changes a chunk here; max_tokens is told.
    """
    if chunk_overlap < 0:
        raise ValueError("chunk_overlap counts sentences")
    ready = gated(docs.select(doc, F.coalesce(F.col(text), F.lit("")).alias("text"))).select(doc, "clean", "passes")
    done = with_chunks(ready, quality).withColumn("said", condensed(F.col("chunks"), backend, workers=workers)).withColumn("summary", N.readability(F.col("said.merged")))
    cosine = text_cosine(F.left("clean", F.lit(8000)), F.left("summary", F.lit(8000)))
    scored = done.withColumn("cos", cosine).withColumns(
        {
            "detection": F.when(F.col("passes"), detect.detection(F.col("clean"), words=F.col("words"))),
            "metrics": F.when(F.col("passes"), metrics.evaluate(F.col("clean"), F.col("summary"), F.col("cos"), rounded=True, words=F.col("words"))),
        }
    )
    total = F.size("chunks")
    null = lambda kind: F.lit(None).cast(kind)
    kinds = {c: scored.schema[c].dataType for c in ("detection", "metrics")} | {
        "doc_type": "string", "confidence": "double", "words": "int", "total_chunks": "int", "max_tokens": "int", "chunk_id": "int", "is_last": "boolean",
        "summary": "string", "chunks_summarized": "int", "compression": "double", "seconds": "double", "message": "string",
    }
    order = ("doc_type", "confidence", "words", "detection", "total_chunks", "max_tokens", "chunk_id", "is_last", "summary", "chunks_summarized", "compression", "metrics", "seconds", "message")

    def event(kind: str, **values: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), *[values[c].cast(kinds[c]).alias(c) if c in values else null(kinds[c]).alias(c) for c in order])

    known = {"doc_type": F.col("detection.type"), "confidence": F.col("detection.confidence")}
    words = {"words": F.col("words")}
    begun = [event("doc_detected", **known, **words, detection=F.col("detection")), event("summary_start", **known, **words, total_chunks=total, max_tokens=F.col("max_tokens"))]
    each = F.transform(
        "said.summaries", lambda s, i: event("chunk_summary", total_chunks=total, chunk_id=i, is_last=i == total - 1, summary=F.coalesce(s, F.lit(FAILED)))
    )
    ratio = F.round(F.col("words") / F.greatest(T.count_tokens(F.col("summary")), F.lit(1)), 1)
    final = event("final", **known, total_chunks=total, summary=F.col("summary"), chunks_summarized=F.col("said.good"), compression=ratio, metrics=F.col("metrics"), seconds=F.col("said.seconds"))
    events = F.when(F.col("passes"), F.concat(F.array(*begun), each, F.array(final))).otherwise(F.array(event("error", message=F.lit("text is too short"))))
    return scored.select(doc, F.posexplode(events).alias("seq", "e")).select(doc, "seq", "e.*")


def adaptive_route(detection: Column) -> Column:
    return (
        F.when((detection["type"] == "book") & (detection["confidence"] > F.lit(0.6)), "book")
        .when((detection["type"] == "paper") & (detection["confidence"] > F.lit(0.5)), "paper")
        .otherwise("general")
    )


class Untidied(models.Merging):
    """The first text, with each other worked in; no tidying at the end."""

    tidied = False


def fold_only(texts: list[str], backend: models.Backend) -> str:
    return models.whole(Untidied, texts, backend)


def routed(route: Column, parts: Column, backend: models.Backend | None = None, workers: int = 1) -> Column:
    """struct<summary, heads> of an array of parts (head, text): of books and papers each part is summarised and what is
    told is worked into one, behind its head in a book; of other texts the parts themselves are. heads: of the parts that
    were told.
    """
    used = backend or models.ExtractiveBackend()

    def one(kind: str, of: list[dict]) -> tuple[str, list[str]]:
        texts = [p["text"] for p in of]
        if kind == "general":
            return models.fold(texts, used), [p["head"] for p in of]
        said = in_order(lambda t: models.summarise_chunk(t, used), texts, workers)
        told = [(p["head"], t) for p, t in zip(of, said, strict=True) if t is not None]
        return fold_only([head + t if kind == "book" else t for head, t in told], used), [head for head, _ in told]

    @F.pandas_udf("struct<summary:string,heads:array<string>>")
    def run(routes: pd.Series, rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(k, list(ps)) for k, ps in zip(routes, rows, strict=True)], columns=["summary", "heads"])

    return run(route, parts)


def adaptive_summarise(docs: DataFrame, doc: str = "doc_id", text: str = "text", backend: models.Backend | None = None, workers: int = 1) -> DataFrame:
    """(doc, doc_type, confidence, summary, title, names, parts, metadata): each document by its type's strategy.

    Detection reads the raw text. Books go by chapter, papers by section, all else by chunk: the route chooses the array
    of parts, and all documents pass one narrow projection. A null text is an empty one; no rows are joined, so those
    with a null or a repeated id are documents of their own.
    """
    none = F.array().cast("array<struct<head:string,text:string>>")
    held = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("d", detect.detection(F.col("text"))).withColumn("route", adaptive_route(F.col("d")))
    general, book, paper = (F.col("route") == k for k in ("general", "book", "paper"))
    cleaned = lines.clean_documents(held.withColumn("plain", F.when(general, F.col("text")).otherwise("")), "plain")
    chapters = cleaned.withColumn("chapters", F.when(book, structure.chapters(F.col("text"))))
    part = lambda head, t: F.struct(head.cast("string").alias("head"), t.alias("text"))
    of_book = F.transform(structure.top_chapters(F.col("chapters")), lambda c: part(F.concat(F.lit("### Chapter "), c["number"], F.lit(": "), c["title"], F.lit("\n")), c["text"]))
    of_paper = F.transform(structure.summarised_sections(structure.sections(F.col("text"))), lambda s: part(s["name"], s["text"]))
    of_general = F.transform(chunking.chunk_or_head(F.col("clean")), lambda c: part(F.lit(""), c["text"]))
    parted = chapters.withColumn("parts", T.settled(F.coalesce(F.when(book, of_book).when(paper, of_paper).otherwise(of_general), none)))
    said = parted.withColumn("said", routed(F.col("route"), F.col("parts"), backend, workers)).withColumn("n", F.size("said.heads"))
    title = F.when(book, structure.book_title(F.col("text"))).when(paper, structure.paper_title(F.col("text")))
    names = F.when(book, F.array(structure.book_author(F.col("text")))).when(paper, structure.paper_authors(F.col("text"))).otherwise(F.array().cast("array<string>"))
    named = said.withColumns({"title": title, "names": names})
    summary = (
        F.when(book, structure.book_layout(F.col("title"), F.get("names", F.lit(0)), F.size("chapters"), F.col("n"), F.col("said.summary")))
        .when(paper, structure.paper_layout(F.col("title"), F.col("names"), F.col("said.heads"), F.col("said.summary")))
        .otherwise(F.col("said.summary"))
    )
    return named.select(F.col("doc").alias(doc), F.col("route").alias("doc_type"), F.col("d.confidence").alias("confidence"), summary.alias("summary"), "title", "names", F.col("n").alias("parts"), F.col("d.metadata").alias("metadata"))
