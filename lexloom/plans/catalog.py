"""The registered queries of the document operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import detect, metrics
from lexloom.functions import normalize as N
from lexloom.functions import predicates as P
from lexloom.functions import text as T
from lexloom.operators import chunking, dedup, lines, models, sparse, structure, vectors
from lexloom.plans import oracle, pipeline
from lexloom.session import remove_at_end, shared_dir, spread, table
from lexloom.sources import documents
from lexloom.sources import paged as paged_files
from lexloom.streaming import events as events_stream
from lexloom.streaming import pages

Query = Callable[[SparkSession, str], DataFrame]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def of_text(**cols: Callable[[Column], Column]) -> Query:
    """A narrow query: doc_id and columns of the whole text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select("doc_id", *[make(F.col("text")).alias(name) for name, make in cols.items()])

    return run


def hashed(make: Callable[[Column], Column]) -> Query:
    """doc_id, length and MD5 of a text made from the whole text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = docs(spark, sf_dir).select("doc_id", make(F.col("text")).alias("t"))
        return made.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))

    return run


def of_lines(**cols: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        return rows.select("doc_id", "pos", *[make(F.col("line")).alias(name) for name, make in cols.items()])

    return run


def of_array(make: Callable[[Column], Column]) -> Query:
    """doc_id, pos and MD5 of each text of an array."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir).select("doc_id", F.posexplode(make(F.col("text"))).alias("pos", "t"))
        return rows.select("doc_id", "pos", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))

    return run


def r6(make: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.round(make(c), 6)


# Inputs that have the structures which the documents lack, made of whole texts.


def book_like(text: Column) -> Column:
    heads = F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lit("Chapter "), (i + 1).cast("string"), F.lit(": Heading of it\n"), x))
    return F.concat(F.lit("THE BOOK OF MANY LINES\nBy: Ann Lee\nContents\n"), F.array_join(heads, "\n"), F.lit("\n"), F.repeat(F.concat(text, F.lit("\n")), F.lit(6)))


def paper_like(text: Column) -> Column:
    odd = F.length(text) % 2 == 1
    return F.concat(
        F.lit("A Study of Made Up Words and Lines\nAnn Lee, 1\nBob Ray, 2\nDepartment of Text\nAbstract\n"), text, F.lit("\nIntroduction\n\n  first words\n"),
        F.when(odd, "Methodology\nhow\nresults\nwhat\nRELATED WORK\nwho\n").otherwise(""), F.lit("Conclusion\n"), text, F.lit("\nabstract\n"),
        F.when(odd, "again\nDiscussion\nwhy\n").otherwise("\n"), F.lit("References\n[1] x\n"),
    )


def ocr_like(text: Column) -> Column:
    return F.concat(text, F.lit("\r\nThe of ce is speci c: 3D v1.5,ok end.Next SIGNI CANT de nition and ef cient.Made with Gamma\r1 inter-\n  national\x07 5 modern clear vv 0\n42\n3.5\n#$%&*\n12 AB X-9 foo"))


def noted(text: Column) -> Column:
    return F.concat(F.lit("### Topic one\n* point:x\n"), text, F.lit("\n\n\n\n\n- point.Again\n\n\n* point:x\n 3. Point x\n### Topic two\nEnd.X\n"))


def paged(text: Column) -> Column:
    """Lines with running heads between them."""
    return F.concat(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(x, F.lit("\nPage 1 of 2\nwww.example.org\n"))), "\n"), F.lit("\nCopyright 2019"))


def condensed(text: Column) -> Column:
    return F.array_join(T.first_sentences(text, 3), " ")


def abbreviated(text: Column) -> Column:
    return F.concat(text, F.lit(" Dr. Who met Mrs. Lee, e.g. Ann. See Fig. A and i.e. Then etc. Ok? Yes! No."))


def sectioned(text: Column) -> Column:
    return F.concat(F.replace(text, F.lit("\n"), F.lit("\n1.2 A ")), F.lit("\n2.1 Last. One"))


def score_columns(like) -> dict:
    return {
        "n_words": lambda c: T.count_tokens(like(c)),
        "book_score": lambda c: F.round(T.let(like(c), lambda t: detect.book_score(t, detect.pages(T.count_tokens(t)))), 6),
        "paper_score": lambda c: F.round(detect.paper_score(like(c)), 6),
    }


def detected(like) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = docs(spark, sf_dir).select("doc_id", detect.detection(like(F.col("text")), digits=None).alias("d"))
        return found.select("doc_id", F.col("d.type").alias("doc_type"), F.round("d.confidence", 6).alias("confidence"), F.round("d.metadata.pages", 6).alias("pages"), F.col("d.metadata.words").alias("words"), F.col("d.metadata.has_chapters").alias("has_chapters"), F.col("d.metadata.has_abstract").alias("has_abstract"), pipeline.adaptive_route(F.col("d")).alias("route"))

    return run


def clean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.clean_documents(docs(spark, sf_dir).select("doc_id", ocr_like(F.col("text")).alias("text")))
    return made.select("doc_id", F.length("clean").alias("n_chars"), F.md5("clean").alias("text_md5"))


def clean_kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.clean_documents(docs(spark, sf_dir).select("doc_id", ocr_like(F.col("text")).alias("text")), keep_newlines=True)
    return made.select("doc_id", F.length("clean").alias("n_chars"), F.md5("clean").alias("text_md5"))


def nfkd_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", N.nfkd(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


def chunks(min_tokens: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = chunking.chunk_documents(docs(spark, sf_dir), min_tokens=min_tokens)
        return made.select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "token_count", F.md5("text").alias("text_md5"))

    return run


def merged_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merge_small() over a table of pieces; chunk_documents does the same inside the row."""
    made = chunking.merge_small(chunking.chunk_pieces(docs(spark, sf_dir)), min_tokens=20)
    return made.select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "token_count", F.md5("text").alias("text_md5"))


def short_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_pieces(docs(spark, sf_dir)).select("doc_id", "pos", F.col("tokens").alias("n_tokens"))


def valid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = docs(spark, sf_dir).select("doc_id", chunking.chunk_or_head(F.col("text"), 20).alias("cs"))
    return made.select("doc_id", F.size("cs").alias("n_chunks"), F.size(F.filter("cs", lambda c: P.valid_chunk(c["text"]))).alias("n_valid"))


def config_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.array(*map(F.lit, ("Fast", "Balanced", "High Quality", "other")))).alias("quality"), (F.length("text") * 10).alias("n"))
    return rows.select("doc_id", "quality", chunking.chunk_config(F.col("quality"), F.col("n")).alias("max_tokens"))


def section_rows(keep=lambda s: s) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir).select("doc_id", F.posexplode(keep(structure.sections(paper_like(F.col("text"))))).alias("pos", "s"))
        return rows.select("doc_id", "pos", "s.name", F.length("s.text").alias("n_chars"), F.md5("s.text").alias("text_md5"))

    return run


def chapter_rows(keep=lambda s: s) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir).select("doc_id", F.posexplode(keep(structure.chapters(book_like(F.col("text"))))).alias("pos", "c"))
        return rows.select("doc_id", "pos", "c.number", "c.title", F.length("c.text").alias("n_chars"), F.md5("c.text").alias("text_md5"))

    return run


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of_book(t: Column, b: Column) -> Column:
        told = lambda ch: structure.book_layout(structure.book_title(b), structure.book_author(b), F.size(ch), F.size(structure.top_chapters(ch)), condensed(t))
        return F.md5(T.let(structure.chapters(b), told))

    def of_paper(t: Column, p: Column) -> Column:
        covered = F.transform(structure.summarised_sections(structure.sections(p)), lambda s: s["name"])
        return F.md5(structure.paper_layout(structure.paper_title(p), structure.paper_authors(p), covered, condensed(t)))

    def made(t: Column) -> list[Column]:
        return [T.let(book_like(t), lambda b: of_book(t, b)).alias("book_md5"), T.let(paper_like(t), lambda p: of_paper(t, p)).alias("paper_md5")]

    return docs(spark, sf_dir).select("doc_id", *made(F.col("text")))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(passage, vs): ten vectors in order, like the chunk summaries of one document."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("passage"), "vec_id", "embedding")
    ordered = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    return rows.groupBy("passage").agg(ordered.alias("o")).select("passage", F.transform("o", lambda x: x["embedding"]).alias("vs"), F.transform("o", lambda x: x["vec_id"]).alias("ids"))


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages(spark, sf_dir).select("passage", "ids", F.explode(vectors.greedy_dedup(F.col("vs"), 0.15)).alias("pos"))
    return kept.select("passage", F.get("ids", F.col("pos")).alias("vec_id"))


def whole_dedup(group: str | None) -> Query:
    """What stays of all embeddings, in the order of their ids, within each label or over the whole table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dedup.greedy_dedup(table(spark, sf_dir, "embeddings"), 0.3, "vec_id", "embedding", group)

    return run


def adjacent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = passages(spark, sf_dir).select("passage", F.posexplode(vectors.adjacent(F.col("vs"))).alias("pos", "c"))
    return sims.select("passage", "pos", F.round("c", 6).alias("cosine"))


def centroid_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine of each vector and the mean of its label; the means, a row for each label and place, are joined."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    means = vectors.centroids(rows, "label", "embedding").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("c"))
    joined = rows.join(means, "label").select("vec_id", "label", vectors.cosine(F.col("embedding"), F.transform("c", lambda x: x["mean"])).alias("cosine"))
    return joined.select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


def threshold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("passage", F.round(chunking.group_threshold(F.transform(vectors.adjacent(F.col("vs")), lambda x: x + F.lit(0.5))), 6).alias("threshold"))


def centroid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return made.select("label", "dim", F.round("mean", 6).alias("mean"))


def fold_query(how: models.Fold) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = models.folded_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn", how=how)
        return made.select("conv_id", F.col("n").cast("int").alias("n"), "summary")

    return run


def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    whole = turns.groupBy("conv_id").agg(documents.join_pages(F.transform(ordered, lambda x: x["text"])).alias("t"))
    return whole.select("conv_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunk_documents(docs(spark, sf_dir))
    return models.summarise_chunks(made).select("doc_id", "chunk_id", "summary")


def semantic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = docs(spark, sf_dir).select("doc_id", chunking.split_sentences(F.col("text")).alias("s"))
    embedded = split.select("doc_id", "s", F.transform("s", lambda x: sparse.dense(sparse.hashed(x, 64), 64)).alias("v"))
    # made inside the generator: of a column Spark would first ask whether it is null or empty, and compute it for each question
    made = embedded.select("doc_id", F.inline(chunking.semantic_chunks(F.col("s"), F.col("v"), 200, 1)))
    return made.select("doc_id", "chunk_id", "token_count", F.md5("text").alias("text_md5"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = docs(spark, sf_dir).select("doc_id", metrics.evaluate(F.col("text"), condensed(F.col("text"))).alias("m"))
    numbers = ["compression_ratio", "coverage", "overall_score", "readability_flesch", "redundancy", "density", "length_penalty"]
    return made.select("doc_id", *[F.round(f"m.{n}", 6).alias(n) for n in numbers], "m.original_words", "m.summary_words")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events. Of what a model says, only that there is something, and that scores lie in their range: those of an
    empty summary count no words.
    """
    made = pipeline.run_pipeline(docs(spark, sf_dir))
    scored = F.col("metrics.overall_score").between(0, 1) & F.coalesce(F.col("metrics.original_words") >= 0, F.lit(True))
    return made.select("doc_id", "seq", "type", "doc_type", "confidence", "words", "total_chunks", "max_tokens", "chunk_id", "is_last", F.length("summary").isNotNull().alias("has_summary"), scored.alias("scored"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final events with what the models say and all scores."""
    made = pipeline.run_pipeline(docs(spark, sf_dir)).filter("type = 'final'")
    return made.select("doc_id", "doc_type", F.round("confidence", 2).alias("confidence"), "total_chunks", "chunks_summarized", "compression", "summary", *[f"metrics.{m}" for m in ("cosine_similarity", "coverage", "density", "redundancy", "readability_flesch", "length_penalty", "overall_score")])


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each type all documents have."""
    return pipeline.run_pipeline(docs(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


def page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a stream of pages, put together again by keyed state; what the stream wrote, read as a table."""
    top = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    remove_at_end(spark, top)
    given = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(given.schema).option("maxBytesPerTrigger", 64 << 30).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern, as a stream takes no single file
    query = pages.page_documents(pages.split_into_pages(stream), events_stream.parquet_sink(f"{top}/out"), f"{top}/state")
    query.awaitTermination()
    made = spark.read.parquet(f"{top}/out")
    return made.select(F.col("doc").alias("doc_id"), "n_pages", "missing", "status", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the table's files, read as pages in ranges: each page's own text, or a stand-in where that is not valid."""
    made = paged_files.read_pages(spark, f"{sf_dir}/documents.parquet", paged_files.ParquetPages())
    text = documents.page_text(F.coalesce("text", F.lit("")), F.lit("recognised"))
    return made.select(text.alias("t")).groupBy(F.md5("t").alias("text_md5"), F.length("t").alias("n_chars")).agg(F.count("*").alias("n"))


def adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.pmod(F.length("text"), F.lit(3))
    text = F.when(shape == 0, book_like(F.col("text"))).when(shape == 1, paper_like(F.col("text"))).otherwise(F.col("text"))
    made = pipeline.adaptive_summarise(docs(spark, sf_dir).select("doc_id", text.alias("text")))
    return made.select("doc_id", "doc_type", F.round("confidence", 2).alias("confidence"), "title", "parts", "summary")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir)


def queries() -> dict[str, Query]:
    def line_kept(make):
        return of_lines(kept=make)

    summary = lambda make: lambda c: F.round(make(c, condensed(c)), 6)
    alone = lambda make: lambda c: F.round(make(condensed(noted(c))), 6)
    return {
        "src_documents": hashed(lambda c: c),
        "ingest_gate": hashed(documents.gate),
        "join_pages": hashed(lambda c: documents.join_pages(F.split(c, "\n"))),
        "page_fallback": hashed(lambda c: documents.join_pages(F.transform(F.split(c, "\n"), lambda p: documents.page_text(p, F.lit("recognised"))))),
        "ordered_concat": ordered_concat,
        "filter_text_valid": of_text(valid=P.text_valid),
        "filter_valid_chunk": of_text(valid=P.valid_chunk),
        "gate_short_docs": of_text(passes=P.long_enough),
        "gate_summaries": of_text(accepted=lambda c: P.summary_ok(condensed(c)), kept=lambda c: P.summary_ok(condensed(c), 10)),
        "filter_data_rows": line_kept(P.data_row),
        "flag_boilerplate_lines": of_lines(boilerplate=P.boilerplate),
        "filter_symbol_lines": line_kept(P.symbol_line_ok),
        "filter_page_numbers": line_kept(lambda c: ~P.page_number(c)),
        "filter_short_sentences": short_sentences,
        "sent_light_cleanup": hashed(N.light_cleanup),
        "norm_newlines": hashed(lambda c: N.newlines(ocr_like(c))),
        "norm_missing_spaces": hashed(lambda c: N.missing_spaces(ocr_like(c))),
        "norm_fix_ocr_text": hashed(lambda c: N.after_stops(ocr_like(c))),
        "norm_dehyphenate": hashed(lambda c: N.dehyphenate(ocr_like(c))),
        "norm_nfkd": nfkd_query,
        "norm_strip_control": hashed(lambda c: N.strip_control(ocr_like(c))),
        "norm_canonical_line": of_lines(canonical=N.canonical),
        "norm_ligatures": hashed(lambda c: N.ligatures(ocr_like(c))),
        "ocr_glyph_fix": hashed(lambda c: N.glyphs(ocr_like(c))),
        "ocr_clean": hashed(lambda c: N.ocr_clean(ocr_like(c))),
        "lines_to_paragraphs": hashed(lambda c: N.paragraphs(T.lines(c))),
        "squeeze_paragraphs": hashed(lambda c: N.per_paragraph(N.paragraphs(T.lines(ocr_like(c))))),
        "clean_documents": clean_query,
        "clean_documents_keep_lines": clean_kept_lines,
        "chunk_clean": hashed(N.chunk_clean),
        "summary_clean": hashed(lambda c: N.summary_clean(noted(c))),
        "summary_readability_fix": hashed(lambda c: N.readability(noted(c))),
        "metric_bullet_normalize": hashed(lambda c: N.bullets(noted(c))),
        "truncations": of_text(**{f"md5_{n}": (lambda n: lambda c: F.md5(F.left(c, F.lit(n))))(n) for n in (150, 3000, 4000, 6000, 8000, 12000)}),
        "dedup_lines_exact": hashed(lambda c: lines.first_lines(noted(c))),
        "dedup_lines_normalized": hashed(lambda c: lines.first_lines(noted(c), lines.loose_key)),
        "remove_repeated_lines": hashed(lambda c: lines.remove_repeated_lines(paged(c), 0.05, 0.9)),
        "remove_repeated_lines_default": hashed(lambda c: lines.remove_repeated_lines(paged(c))),
        "count_tokens": of_text(n_tokens=T.count_tokens),
        "split_paragraphs": of_array(lambda c: chunking.split_paragraphs(sectioned(c))),
        "split_sentences": of_array(lambda c: chunking.split_sentences(abbreviated(c))),
        "overlap_sentences": of_array(lambda c: chunking.last_sentences(chunking.split_sentences(abbreviated(c)))),
        "adjacent_similarity": adjacent_query,
        "group_threshold": threshold_query,
        "semantic_chunks": semantic_query,
        "merge_small_chunks": merged_pieces,
        "chunk_documents": chunks(chunking.MIN_TOKENS),
        "chunk_config": config_query,
        "valid_chunks": valid_chunks,
        "detect_book_score": of_text(**score_columns(book_like)),
        "detect_paper_score": of_text(**score_columns(paper_like)),
        "detect_document_type": detected(lambda c: c),
        "adaptive_route_books": detected(book_like),
        "adaptive_route_papers": detected(paper_like),
        "extract_sections": section_rows(),
        "skip_references": section_rows(structure.summarised_sections),
        "detect_chapters": chapter_rows(),
        "top_chapters": chapter_rows(structure.top_chapters),
        "extract_title_paper": of_text(title=lambda c: structure.paper_title(c), title_like=lambda c: structure.paper_title(paper_like(c))),
        "extract_title_book": of_text(title=lambda c: structure.book_title(c), title_like=lambda c: structure.book_title(book_like(c))),
        "extract_authors": of_text(authors=lambda c: F.array_join(structure.paper_authors(F.concat(paper_like(c), F.lit("\nAuthor: Cy Poe\nBy: Di Fox"))), "|")),
        "extract_author_book": of_text(author=lambda c: structure.book_author(book_like(c)), rights=lambda c: structure.book_author(F.concat(c, F.lit("\n© 2020 Eve Sun"))), unknown=structure.book_author),
        "format_summaries": layouts,
        "metric_syllables": of_text(n_syllables=lambda c: T.total(F.transform(F.regexp_extract_all(T.plain_words(c), F.lit(metrics.WORD), F.lit(0)), metrics.syllables))),
        "metric_flesch": of_text(flesch=alone(metrics.flesch), flesch_all=r6(metrics.flesch)),
        "metric_coverage": of_text(coverage=summary(metrics.coverage)),
        "metric_redundancy": of_text(redundancy=r6(metrics.redundancy), redundancy_twice=lambda c: F.round(metrics.redundancy(F.concat(c, F.lit(" "), c)), 6)),
        "metric_density": of_text(density=r6(metrics.density)),
        "metric_compression": of_text(compression=summary(metrics.compression), score=lambda c: F.round(metrics.compression_score(metrics.compression(c, condensed(c))), 6)),
        "metric_length_penalty": of_text(penalty=summary(metrics.length_penalty)),
        "evaluate_summaries": evaluated,
        "cosine_pairs": centroid_cosines,
        "semantic_dedup": whole_dedup("label"),
        "semantic_dedup_all": whole_dedup(None),
        "passage_dedup": dedup_query,
        "centroid_by_label": centroid_query,
        "chunk_summaries": chunk_summaries,
        "refine_fold": fold_query(models.Refining),
        "merge_summaries": fold_query(models.Merging),
        "pipeline_events": events,
        "pipeline_event_counts": event_counts,
        "pipeline_summaries": summaries,
        "adaptive_summaries": adaptive,
        "page_stream": page_stream,
        "page_ranges": page_ranges,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
