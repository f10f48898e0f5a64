"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE_RE2 as WS
from ..session import remove, scratch, stored
from ..sources import tables
from ..functions import vectors as V
from . import clusters, containers, history, mixing, neighbours, pieces, pii, records, tokens

MODEL = "emb-base-v2"
DIM = 128


#: Rows from which p1_found ingests what has arrived. An ingest plans some ten jobs however small it is.
ARRIVAL = 25_000
#: Bits of a paragraph id.
ID_BITS = 44


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Redeliveries are resolved first; rows without a batch belong to the history.

    Batches are ingested as they arrive, small ones together with the next: an ingest
    decides its rows in order of arrival (batch, then id), so the result is the same. Ids
    of the index say both: the batch in the upper bits, the paragraph's id in the lower.
    """
    rows = tables.deliveries(tables.table(spark, d, "paragraphs")).where(F.col("text").isNotNull())
    batch = F.greatest(F.coalesce("batch", F.lit(0)), F.lit(0)).cast("bigint")
    fits = F.when(F.col("id").between(0, (1 << ID_BITS) - 1), F.col("id")).otherwise(F.raise_error(F.lit("paragraph id out of range")).cast("bigint"))
    rows = rows.select((F.shiftleft(batch, ID_BITS) + fits).alias("id"), "text", batch.alias("batch"))
    # One folder a batch, so that the arrival of one reads nothing of the others.
    arrivals = scratch(spark, "arrivals")
    rows.write.partitionBy("batch").parquet(arrivals)
    rows = spark.read.schema(rows.schema).parquet(arrivals)
    waiting: list[int] = []
    held, index = 0, history.History.create(spark, scratch(spark, "history"))
    sizes = sorted(rows.groupBy("batch").count().collect())  # one row a batch
    for b, n in sizes:
        if b == 0:
            index.accept_all(rows.where("batch = 0"))
            continue
        waiting, held = [*waiting, b], held + n
        if held >= ARRIVAL or b == sizes[-1][0]:
            index.ingest(rows.where(F.col("batch").isin(waiting)))
            waiting, held = [], 0
    rejected = rows.where(F.col("batch") > 0).select("id").join(index.nodes().withColumnRenamed("node", "id"), "id", "left_anti")
    found = stored(rejected.select(F.col("id").bitwiseAND((1 << ID_BITS) - 1).alias("paragraph_id")), "p1")
    index.delete()
    remove(spark, arrivals)
    return found


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    paras = tables.deliveries(tables.table(spark, d, "paragraphs"))
    return pieces.split_items(tables.table(spark, d, "chunks"), paras).withColumnRenamed("id", "chunk_id")


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized chunk the words its pieces hold without their overlaps, and whether each keeps the limit and its overlap."""
    held = p2_pieces(spark, d).groupBy("chunk_id").agg(
        F.sum(F.col("words") - F.col("overlap")).alias("words"), F.max("words").alias("most"), F.min(F.when(F.col("piece") > 0, F.col("overlap"))).alias("least"),
    )
    return held.select("chunk_id", "words", (F.col("most") <= 400).alias("within"), (F.col("least") > 0).alias("overlapping"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = pieces.split_items(tables.table(spark, d, "chunks"))
    return out.where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select(F.col("id").alias("chunk_id"))


def _vectors(spark, d, kind: str) -> DataFrame:
    """``key, vec`` of the current model's usable vectors of a kind, the latest written of each ``fp``."""
    v = tables.table(spark, d, "vectors").where((F.col("model") == MODEL) & (F.col("kind") == kind) & F.col("fp").isNotNull())
    fit = v.where(V.usable(F.col("vec"), DIM))
    return fit.groupBy(F.col("fp").alias("key")).agg(F.max(F.struct("written_at", "vec")).alias("x")).select("key", "x.vec")


def _p3_items(spark, d) -> DataFrame:
    c = tables.table(spark, d, "clusters").where(F.col("cluster_id").isNotNull() & V.usable(F.col("centroid"), DIM))
    c = c.groupBy(F.col("cluster_id").alias("key")).agg(F.max(F.struct("created_at", "centroid")).alias("x"))
    return _vectors(spark, d, "chunk").unionByName(c.select("key", F.col("x.centroid").alias("vec")))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(stored(_p3_items(spark, d), "items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = p3_neighbours(spark, d)
    return near.select(F.least("key", "other").alias("a_key"), F.greatest("key", "other").alias("b_key")).distinct()


def _p5(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = clusters.units(_vectors(spark, d, "paragraph"))
    leaves = clusters.divide(rows)
    return clusters.confirm(stored(clusters.assign(leaves, rows), "clusters"), rows), leaves, rows


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = _p5(spark, d)[0].where(F.col("key") != F.col("cluster"))
    return found.select(F.col("cluster").alias("first_fp"), F.col("key").alias("member_fp"))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """All usable vectors, each in one cluster; those with no other within the limit are clusters of one."""
    found, leaves, rows = _p5(spark, d)
    return clusters.describe(stored(clusters.divided(leaves, found).join(rows, "key"), "members"), DIM)


def _texts(spark, d) -> DataFrame:
    return tables.deliveries(tables.table(spark, d, "paragraphs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    g = records.equal_groups(_texts(spark, d))
    return g.where(F.col("id") != F.col("keep")).select(F.col("keep").alias("keep_id"), F.col("id").alias("copy_id"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return records.collapsed(_texts(spark, d)).select(F.col("id").alias("keep_id"), "copies")


def _sizes(spark, d) -> DataFrame:
    return stored(tokens.sizes(tables.table(spark, d, "documents"), "doc_id", keep=("source",)), "sizes")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers.fill(spark, _sizes(spark, d), tables.table(spark, d, "capacities"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return containers.fill_summary(p6_containers(spark, d), tables.table(spark, d, "capacities"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Of each capacity how many documents are placed whole, and how many containers hold more than they may."""
    sizes, caps = _sizes(spark, d), tables.table(spark, d, "capacities")
    filled = stored(containers.fill(spark, sizes, caps), "filled")
    placed = filled.groupBy("capacity_id", "doc_id").agg(F.sum("tokens").alias("held")).join(sizes.select("doc_id", "tokens"), "doc_id")
    whole = placed.where(F.col("held") == F.col("tokens")).groupBy("capacity_id").agg(F.count(F.lit(1)).alias("documents"))
    full = filled.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("t")).join(F.broadcast(caps), "capacity_id")
    return whole.join(full.groupBy("capacity_id").agg(F.count_if(F.col("t") > F.col("max_tokens")).alias("over")), "capacity_id")


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """Each mix is to have all the tokens its sources have; larger documents are likelier, in proportion to their tokens."""
    return mixing.draw(_sizes(spark, d), tables.table(spark, d, "mix_targets"), total_tokens="all", weight="tokens")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source of each mix was to give, gave, and lacks."""
    sizes, targets = _sizes(spark, d), tables.table(spark, d, "mix_targets")
    drawn = stored(mixing.draw(sizes, targets, total_tokens="all", weight="tokens"), "drawn")
    return mixing.shares(drawn, sizes, targets, "all")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.table(spark, d, "documents")
    return pii.mentions(docs, pii.lexicon_of(tables.table(spark, d, "staff"), docs)).select("doc_id", "kind", "start_at")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.table(spark, d, "documents")
    return pii.redacted(docs, pii.lexicon_of(tables.table(spark, d, "staff"), docs))


ALL = (p1_found, p2_found, p2_pieces, p2_coverage, p3_found, p3_neighbours, p4_found, p4_groups, p5_found, p5_clusters, p6_containers, p6_summary, p6_check, p7_selection, p7_shares, p8_found, p8_redacted)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""SELECT DISTINCT id AS chunk_id FROM chunks WHERE text IS NOT NULL
            AND len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')) > 400""",
        "p2_coverage": f"""WITH c AS (SELECT id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id),
            w AS (SELECT id, len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')) AS words FROM chunks JOIN c USING (id, text))
            SELECT DISTINCT id AS chunk_id, CAST(words AS BIGINT) AS words, true AS within, true AS overlapping FROM w WHERE words > 400""",
        "p6_check": "SELECT capacity_id, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS over FROM capacities",
        # Members of a cluster all have the same neighbours: the cluster itself.
        "p5_found": f"""WITH v AS (SELECT fp, list_transform(any_value(vec), lambda x: x::DOUBLE) AS v FROM vectors
              WHERE model = '{MODEL}' AND kind = 'paragraph' AND fp IS NOT NULL AND len(vec) = {DIM}
              AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY fp),
            n AS (SELECT fp, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v),
            e AS (SELECT a.fp AS a, b.fp AS b FROM n a JOIN n b ON list_dot_product(a.v, b.v) >= 0.75),
            g AS (SELECT a, string_agg(b, ',' ORDER BY b) AS members, min(b) AS first_fp, count(*) AS n FROM e GROUP BY a),
            c AS (SELECT members FROM g GROUP BY members, n HAVING n >= 2 AND count(*) = n)
            SELECT first_fp, a AS member_fp FROM g WHERE members IN (SELECT members FROM c) AND a <> first_fp""",
    }
