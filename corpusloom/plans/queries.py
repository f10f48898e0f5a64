"""The reference operators as queries over a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import findings as fd
from ..operators import grading as gr
from ..operators import models as md
from ..operators import packing, passport, sampling, signals, similarity, split, tags, topics
from ..operators.corpus import Corpus, corpus_totals
from ..operators.corpus import source_totals as totals_by_source
from ..session import stored
from ..sources import tables
from ..sources.config import Config, Profile
from ..streaming.arrivals import known_fingerprints, new_texts

#: The embeddings table is random by design: the defaults of 0.95 and 0.82 give no rows on it.
PAIR_COSINE = 0.40
CENTRE_COSINE = 0.30
SWEEP = (0.30, 0.35, 0.40, 0.45, 0.50)
MODEL = "emb-base-v2"
TOPICS = ("service credit", "fire drill", "quantum optics", "ticket queue", "loan desk")
TOPIC_COSINE = 0.30
#: Thresholds of the finding queries: the production one, and one that the paragraphs of the test data reach.
NEAR, GENERIC = 0.95, 0.40


def _documents(spark, d) -> DataFrame:
    return tables.documents_as_files(spark, d)


def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    rows = split.split_paragraphs(_documents(spark, d))
    return rows.select(
        F.col("source").cast("bigint").alias("doc_id"),
        F.col("position").cast("bigint").alias("position"),
        T.fingerprint(F.col("text")).alias("fp"),
        T.word_count(F.col("text")).cast("bigint").alias("words"),
    )


def dense_paragraph_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = split.read_paragraphs(_documents(spark, d))
    return rows.select("id", F.col("source").cast("bigint").alias("doc_id"), F.col("position").cast("bigint").alias("position"))


def fingerprint_words(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    words = T.word_count(text)
    return (
        tables.table(spark, d, "documents")
        .where(text.isNotNull())
        .select(
            "doc_id", T.fingerprint(text).alias("fp"), words.cast("bigint").alias("words"),
            T.preview(text, 48).alias("preview"), T.token_estimate(words).cast("bigint").alias("tokens"),
        )
    )


def corpus_size(spark: SparkSession, d: str) -> DataFrame:
    return corpus_totals(tables.paragraphs(spark, d))


def source_totals(spark: SparkSession, d: str) -> DataFrame:
    return totals_by_source(tables.paragraphs(spark, d))


_GROUP = ("fp", "severity", "copies", "n_sources", "first_id", "message")


def exact_dupes(spark: SparkSession, d: str) -> DataFrame:
    return signals.duplicate_groups(tables.paragraphs(spark, d)).select(*_GROUP)


def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return signals.boilerplate_groups(tables.paragraphs(spark, d)).select(*_GROUP, "share")


def duplication_pct(spark: SparkSession, d: str) -> DataFrame:
    return passport.duplication(tables.paragraphs(spark, d))


def _line_paragraphs(spark, d) -> DataFrame:
    rows = tables.measured(split.split_paragraphs(_documents(spark, d)))
    return rows.withColumn("id", F.col("position").cast("bigint"))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = packing.chunk_rows(_line_paragraphs(spark, d))
    return rows.select(
        F.col("source").cast("bigint").alias("doc_id"), "chunk", "fp", F.col("words").cast("bigint").alias("words"),
        F.array_min("paragraph_ids").alias("first_position"), F.size("paragraph_ids").cast("bigint").alias("paragraphs"),
    )


def length_outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.length_outliers(packing.chunk_rows(_line_paragraphs(spark, d)))
    return rows.select(F.col("source").cast("bigint").alias("doc_id"), "chunk", F.col("words").cast("bigint").alias("words"), "problem", "message")


def near_dupes(spark: SparkSession, d: str) -> DataFrame:
    pairs = signals.near_pairs(tables.table(spark, d, "embeddings"), "vec_id", "embedding", PAIR_COSINE)
    return pairs.select("a", "b", F.round("score", 4).alias("score"), "severity")


def near_dupe_links(spark: SparkSession, d: str) -> DataFrame:
    """Chunk vectors at the production threshold: class and number of links. Of vectors of one ``fp`` the greatest stands."""
    v = tables.table(spark, d, "vectors").where((F.col("model") == MODEL) & (F.col("kind") == "chunk") & F.col("fp").isNotNull())
    v = stored(v.where(V.usable(F.col("vec"), 128)).groupBy("fp").agg(F.max("vec").alias("vec")), "chunk-vectors")
    reps, members = similarity.classes(v, "fp", "vec")
    pairs = stored(similarity.cosine_pairs(reps, "class_id", "vec", Config().near_duplicate), "near-dupe-pairs")
    ends = pairs.select(F.col("a").alias("class_id")).unionAll(pairs.select(F.col("b").alias("class_id")))
    links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, "class_id", "left").select(
        F.col("key").alias("fp"), "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")
    )


def generic(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.centre_scores(tables.table(spark, d, "embeddings"), "embedding")
    return rows.where(F.col("score") >= CENTRE_COSINE).select("vec_id", F.round("score", 4).alias("score"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 100 asks all rows."""
    v = tables.table(spark, d, "embeddings")
    found = similarity.top_k_of_many(v, v.where(F.col("vec_id") % 100 == 0), "vec_id", Config().top_k, "embedding")
    return found.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


def embedding_cache_miss(spark: SparkSession, d: str) -> DataFrame:
    p = tables.paragraphs(spark, d).where(F.col("words") >= topics.LEAST_WORDS)
    cache = tables.table(spark, d, "vectors").where((F.col("model") == MODEL) & (F.col("kind") == "paragraph"))
    return md.cache_misses(p, cache).select("fp", T.word_count(F.col("text")).cast("bigint").alias("words"))


def known_fp_check(spark: SparkSession, d: str) -> DataFrame:
    p = tables.paragraphs(spark, d)
    known = known_fingerprints(p.where(F.col("batch") == 0))
    return new_texts(p.where(F.col("batch") > 0).select("text"), known).select("fp")


def staleness(spark: SparkSession, d: str) -> DataFrame:
    p = tables.paragraphs(spark, d)
    return passport.staleness(p, p.where(F.col("batch") < 5))


def _pack_domain(spark, d) -> DataFrame:
    """Chunks of the paragraphs table, ids by source and ordinal."""
    return packing.pack_chunks(tables.paragraphs(spark, d).where(F.col("text") != ""))


def domain_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _pack_domain(spark, d).select("id", "source", "fp", F.col("words").cast("bigint").alias("words"), F.size("paragraph_ids").cast("bigint").alias("paragraphs"))


def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    c = tables.table(spark, d, "chunks").where(F.col("text").isNotNull()).groupBy("id").agg(F.max("source").alias("source"), F.max("text").alias("text"))
    c = c.withColumn("words", T.word_count(F.col("text")))
    return sampling.round_robin(c).select("id", "source", F.col("ord").cast("bigint").alias("ord"), F.col("words").cast("bigint").alias("words"))


def label_sample(spark: SparkSession, d: str) -> DataFrame:
    v = tables.table(spark, d, "embeddings")
    fit = v.where(V.usable(F.col("embedding"))).withColumn("u", V.normalise(F.col("embedding")))
    means = fit.select("label", F.posexplode("u")).groupBy("label", "pos").agg(F.avg("col").alias("m"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"])
    centres = means.groupBy("label").agg(V.normalise(mean).alias("centre"))
    rows = fit.join(centres, "label").select("vec_id", "label", F.round(V.dot(F.col("u"), F.col("centre")), 4).alias("score"))
    rows = rows.withColumn("words", (F.col("vec_id") % 200 + 20).cast("bigint"))
    return sampling.label_sample(rows, "label", "score", tie="vec_id").select("label", "vec_id", "score", F.col("rn").cast("bigint").alias("rn"), "running_words")


def _saved_clusters(spark, d) -> DataFrame:
    """The old inventory without rows saved twice."""
    cols = ("label_proposed", "paragraphs", "words", "representative")
    c = tables.table(spark, d, "clusters")
    return c.groupBy("cluster_id").agg(F.max(F.struct("created_at", *cols)).alias("c")).select("cluster_id", *[f"c.{x}" for x in cols], "c.created_at")


def snippet_resolve(spark: SparkSession, d: str) -> DataFrame:
    snippets = _saved_clusters(spark, d).select(F.col("cluster_id").alias("snippet_id"), F.col("representative").alias("snippet"))
    return gr.resolve_snippets(tables.paragraphs(spark, d), snippets)


def _defects(spark, d) -> tuple[DataFrame, DataFrame]:
    """Old clusters as if they were planted defects, of a kind by their words."""
    c = _saved_clusters(spark, d)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("exact_duplicate", "boilerplate", "length_outlier", "off_topic")]), (F.col("words") % 4 + 1).cast("int"))
    defects = c.select(F.lit("all").alias("case"), F.col("cluster_id").alias("id"), F.array(kind).alias("kinds"))
    return defects, c.select(F.lit("all").alias("case"), F.col("cluster_id").alias("id"), F.explode("paragraphs").alias("paragraph_id")).distinct()


def _corpus(spark, d) -> Corpus:
    p = stored(tables.paragraphs(spark, d), "paragraphs")
    return Corpus.of_tables(p, stored(packing.pack_chunks(p.where(F.col("text") != "")), "chunks"), Config())


def _tier0(spark, d, corpus: Corpus | None = None) -> fd.Findings:
    """All three detectors that read text only."""
    corpus = corpus or _corpus(spark, d)
    return fd.union_all([s.run(corpus, corpus.config) for s in signals.select(0)])


def _graded(spark, d):
    corpus = _corpus(spark, d)
    found = gr.finding_paragraphs(_tier0(spark, d, corpus), corpus.chunks)
    defects, resolved = _defects(spark, d)
    detects = gr.detects_frame(spark, 0)
    return found, defects, resolved, detects


def bench_score(spark: SparkSession, d: str) -> DataFrame:
    return gr.score(*_graded(spark, d))


def bench_defect_level(spark: SparkSession, d: str) -> DataFrame:
    return gr.defect_level(*_graded(spark, d))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    pairs = signals.near_pairs(tables.table(spark, d, "embeddings"), "vec_id", "embedding", min(SWEEP))
    values = spark.createDataFrame([(v,) for v in SWEEP], "value double")
    return gr.threshold_sweep(pairs, "score", values)


def findings_ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = fd.ranked(_tier0(spark, d))
    return rows.select("signal", "kind", "key", "severity", "message", "n_items", "n_sources")


def findings_summary(spark: SparkSession, d: str) -> DataFrame:
    return fd.summary(_tier0(spark, d))


def findings_flagged(spark: SparkSession, d: str) -> DataFrame:
    return fd.flagged_paragraphs(_tier0(spark, d))


def findings_top_per_signal(spark: SparkSession, d: str) -> DataFrame:
    return fd.top_per_signal(_tier0(spark, d)).select(
        "signal", "key", F.col("shown").cast("bigint").alias("shown"), F.col("more").cast("bigint").alias("more")
    )


def _tags(spark, d) -> DataFrame:
    c = _saved_clusters(spark, d).where(F.col("label_proposed").isNotNull())
    status = F.element_at(F.array(*[F.lit(x) for x in tags.STATUSES]), (F.col("words") % 3 + 1).cast("int"))
    empty = F.lit("")
    return c.select(
        F.lit("topic").alias("group"), F.col("label_proposed").alias("label"), empty.alias("reasoning"), status.alias("status"),
        F.lit("model").alias("source"), F.array().cast("array<string>").alias("evidence"), F.col("cluster_id").alias("key"),
        F.col("cluster_id").alias("ord"),
    )


def tag_merge(spark: SparkSession, d: str) -> DataFrame:
    current = _tags(spark, d).drop("ord")
    again = current.withColumns({"status": F.lit("proposed"), "label": F.upper("label")})
    other = current.withColumns({"status": F.lit("proposed"), "label": F.concat(F.lit("new "), "label"), "key": F.lit("")})
    return tags.merge_proposals(current, again.unionByName(other), ("topic",)).select("group", "label", "status", "key")


def topic_checks(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame(list(enumerate(TOPICS)), "ord int, topic string")
    return passport.topic_checks(wanted, _tags(spark, d), True, 0).select("topic", "verdict", "label")


PROFILE = Profile("answering questions", TOPICS, max_duplication_pct=30.0, min_words=500)


def passport_checks(spark: SparkSession, d: str) -> DataFrame:
    p = tables.paragraphs(spark, d)
    return passport.size_checks(PROFILE, corpus_totals(p), passport.duplication(p)).select("verdict", "requirement", "note")


def passport_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Graded against an inventory taken at batch 4, so that topics wait if the text has changed since."""
    wanted = spark.createDataFrame(list(enumerate(TOPICS)), "ord int, topic string")
    stale = staleness(spark, d).first()["changed"]
    topics_ = passport.topic_checks(wanted, _tags(spark, d), True, stale)
    return passport.overall(passport_checks(spark, d).select("verdict").unionAll(topics_.select("verdict")))


def topic_lines(spark: SparkSession, d: str) -> DataFrame:
    """Some half of the clusters have a tag."""
    tags_ = _tags(spark, d).where(F.col("key") < "8")
    return passport.topic_lines(_saved_clusters(spark, d), tags_).select("cluster_id", "label", "standing")


def _vector_corpus(spark, d) -> Corpus:
    """Chunks and paragraphs with the vectors of the cache."""
    c = tables.table(spark, d, "chunks").where(F.col("text").isNotNull()).groupBy("id").agg(F.max("source").alias("source"), F.max("text").alias("text"))
    corpus = Corpus.of_tables(tables.paragraphs(spark, d), tables.measured(c), Config(near_duplicate=NEAR, generic_threshold=GENERIC))
    v = tables.table(spark, d, "vectors").where((F.col("model") == MODEL) & F.col("fp").isNotNull() & V.usable(F.col("vec"), 128))
    for kind in ("chunk", "paragraph"):
        corpus.__dict__[f"{kind}_vectors"] = stored(v.where(F.col("kind") == kind).groupBy("fp").agg(F.max("vec").alias("vec")), "vectors")
    return corpus


def near_dupe_findings(spark: SparkSession, d: str) -> DataFrame:
    corpus = _vector_corpus(spark, d)
    return signals.near_dupes(corpus, corpus.config).rows.select("key", "severity", "message", "n_sources")


def generic_findings(spark: SparkSession, d: str) -> DataFrame:
    corpus = _vector_corpus(spark, d)
    return signals.generic(corpus, corpus.config).rows.select("key", "severity", "message")


def topic_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = tables.paragraphs(spark, d)
    members = _saved_clusters(spark, d).select(F.col("cluster_id").alias("cluster"), F.explode("paragraphs").alias("id")).distinct().join(p, "id")
    total = p.agg(F.sum("words").alias("total"))
    return topics.coverage(members, total)


def cluster_ids(spark: SparkSession, d: str) -> DataFrame:
    p = tables.paragraphs(spark, d)
    members = _saved_clusters(spark, d).select(F.col("cluster_id").alias("cluster"), F.explode("paragraphs").alias("id")).join(p, "id")
    return topics.cluster_ids(members)


def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = tables.table(spark, d, "embeddings")
    return topics.agglomerate(v, "vec_id", "embedding", TOPIC_COSINE, Config().max_topics).withColumnRenamed("key", "vec_id")


ALL = (
    paragraph_split, dense_paragraph_ids, fingerprint_words, corpus_size, source_totals, exact_dupes, boilerplate, duplication_pct,
    chunk_pack, length_outliers, domain_chunks, near_dupes, near_dupe_links, generic, vector_topk, embedding_cache_miss,
    known_fp_check, staleness, round_robin_sample, label_sample, snippet_resolve, bench_score, bench_defect_level,
    threshold_sweep, findings_ranked, findings_summary, findings_flagged, findings_top_per_signal, tag_merge, topic_checks,
    passport_checks, passport_verdict, topic_lines, topic_coverage, cluster_ids, topic_clusters, near_dupe_findings, generic_findings,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The tier-0 report of documents: split, pack, three detectors, ranked findings."""
    corpus = Corpus(_documents(spark, d), Config(max_tier=0))
    parts = [s.run(corpus, corpus.config) for s in signals.select(0)]
    return fd.ranked(fd.union_all(parts)).select("signal", "kind", "key", "severity", "message", "n_items", "n_sources")
