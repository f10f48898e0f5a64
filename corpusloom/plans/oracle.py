"""The same queries in plain SQL for DuckDB."""

from __future__ import annotations

from ..functions.text import SPACE_RE2 as WS
from ..sources.config import Config
from . import queries as q

_C = Config()


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def _measures(x: str = "text") -> str:
    one = _collapsed(x)
    return (
        f"substr(sha256(lower({one})), 1, 16) AS fp, "
        f"CAST(CASE WHEN {one} = '' THEN 0 ELSE length({one}) - length(replace({one}, ' ', '')) + 1 END AS BIGINT) AS words"
    )


_P = f"""p AS (
  SELECT id, source, position, text, batch, {_measures()} FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, source DESC NULLS LAST,
      position DESC NULLS LAST, text DESC NULLS LAST, batch DESC NULLS LAST) AS rn
    FROM paragraphs WHERE id IS NOT NULL) WHERE rn = 1 AND text IS NOT NULL)"""

_BLOCKS = f"""b AS (
  SELECT doc_id, position, text, {_measures()} FROM (
    SELECT doc_id, position, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS text FROM (
      SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS raw,
        unnest(range(len(string_split(text, chr(10) || chr(10))))) AS position
      FROM documents WHERE text IS NOT NULL)) WHERE text <> '')"""

_GROUPS = f"""{_P}, f AS (SELECT count(DISTINCT source) AS total_files FROM p),
g AS (SELECT fp, CAST(count(*) AS BIGINT) AS copies, CAST(count(DISTINCT source) AS BIGINT) AS n_sources, min(id) AS first_id,
  arg_min(substr({_collapsed('text')}, 1, 48), id) AS preview FROM p GROUP BY fp),
d AS (SELECT fp, CASE WHEN n_sources >= 3 THEN 'low' ELSE 'medium' END AS severity, copies, n_sources, first_id,
  'identical paragraph appears ' || copies || 'x in ' || n_sources || ' file(s): "' || preview || '..."' AS message FROM g WHERE copies >= 2),
w AS (SELECT fp, CASE WHEN n_sources / greatest(total_files, 1) >= 0.5 THEN 'high' ELSE 'medium' END AS severity, copies, n_sources, first_id,
  'boilerplate in ' || n_sources || '/' || total_files || ' files (' || CAST(round_even(100.0::DOUBLE * (n_sources::DOUBLE / total_files), 0) AS BIGINT) || '%): "' || preview || '..."' AS message,
  CAST(round_even((n_sources::DOUBLE / greatest(total_files, 1)), 3) AS DOUBLE) AS share
  FROM g, f WHERE n_sources >= least(3, greatest(2, total_files)))"""

_DOMAIN = f"""do_ AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position NULLS FIRST, id) AS rn FROM p WHERE text <> ''),
dk AS (SELECT source, rn, words AS held, 0 AS chunk FROM do_ WHERE rn = 1 UNION ALL
  SELECT o.source, o.rn, CASE WHEN k.held > 0 AND k.held + o.words > {_C.target_words} THEN o.words ELSE k.held + o.words END,
    CASE WHEN k.held > 0 AND k.held + o.words > {_C.target_words} THEN k.chunk + 1 ELSE k.chunk END FROM dk k JOIN do_ o ON o.source = k.source AND o.rn = k.rn + 1),
dt AS (SELECT o.source, k.chunk, string_agg(o.text, chr(10) || chr(10) ORDER BY o.rn) AS text, count(*) AS paragraphs, list(o.id) AS ids
  FROM dk k JOIN do_ o ON o.source = k.source AND o.rn = k.rn GROUP BY o.source, k.chunk),
dm AS (SELECT *, {_measures()} FROM dt),
dc AS (SELECT CAST(row_number() OVER (ORDER BY string_split(source, '/'), chunk) - 1 AS BIGINT) AS id, source, text, fp, words, paragraphs, ids FROM dm WHERE words >= {_C.min_words})"""

_FINDINGS = f"""{_GROUPS}, {_DOMAIN}, r AS (
  SELECT 'exact_dupes' AS signal, 'exact_duplicate' AS kind, fp AS key, severity, message, copies AS n_items, n_sources FROM d
  UNION ALL SELECT 'boilerplate', 'boilerplate', fp, severity, message, copies, n_sources FROM w
  UNION ALL SELECT 'length', 'length_outlier', CAST(id AS VARCHAR), 'info', 'chunk ' || CASE WHEN words < {_C.length_short} THEN 'too short' ELSE 'too long' END ||
    ' (' || words || ' words) in ' || source || ': "' || substr({_collapsed('text')}, 1, 40) || '..."', 1, 1 FROM dc WHERE words < {_C.length_short} OR words > {_C.length_long})"""

_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"

_PACK = f"""{_BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS rn FROM b),
k AS (SELECT doc_id, rn, words AS held, 0 AS chunk FROM o WHERE rn = 1
  UNION ALL
  SELECT o.doc_id, o.rn, CASE WHEN k.held > 0 AND k.held + o.words > {_C.target_words} THEN o.words ELSE k.held + o.words END,
    CASE WHEN k.held > 0 AND k.held + o.words > {_C.target_words} THEN k.chunk + 1 ELSE k.chunk END
  FROM k JOIN o ON o.doc_id = k.doc_id AND o.rn = k.rn + 1),
t AS (SELECT o.doc_id, CAST(k.chunk AS BIGINT) AS chunk, string_agg(o.text, chr(10) || chr(10) ORDER BY o.rn) AS text,
  CAST(min(o.position) AS BIGINT) AS first_position, CAST(count(*) AS BIGINT) AS paragraphs
  FROM k JOIN o ON o.doc_id = k.doc_id AND o.rn = k.rn GROUP BY o.doc_id, k.chunk),
c AS (SELECT *, {_measures()} FROM t)"""

_E = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)"""


def _pairs(t: float) -> str:
    return f"""{_E}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS score
      FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= {t})"""


def _centre(by: str = "") -> str:
    part = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{_E}, x AS (SELECT {part}pos, avg(val) AS m FROM (SELECT {part}unnest(v) AS val, unnest(range(len(v))) AS pos FROM u) GROUP BY {part}pos),
      m AS (SELECT {part}list(m ORDER BY pos) AS m FROM x {group}),
      z AS (SELECT {part}list_transform(m, lambda y: y / sqrt(list_dot_product(m, m))) AS c FROM m)"""


def _cached(kind: str) -> str:
    """The usable vectors of a kind, the greatest of each ``fp``."""
    return f"""vv AS (SELECT fp, list_transform(max(vec), lambda x: x::DOUBLE) AS v FROM vectors WHERE model = '{q.MODEL}' AND kind = '{kind}' AND fp IS NOT NULL
      AND len(vec) = 128 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY fp)"""


_CL = """cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC NULLS LAST) AS rn FROM clusters) WHERE rn = 1)"""

_TRUTH = f"""{_FINDINGS}, {_CL},
def AS (SELECT cluster_id AS id, CASE words % 4 WHEN 0 THEN 'exact_duplicate' WHEN 1 THEN 'boilerplate' WHEN 2 THEN 'length_outlier' ELSE 'off_topic' END AS kind, paragraphs FROM cl),
res AS (SELECT DISTINCT id, kind, unnest(paragraphs) AS paragraph_id FROM def),
det AS (SELECT * FROM (VALUES ('boilerplate', 'boilerplate'), ('exact_dupes', 'exact_duplicate'), ('length', 'length_outlier')) AS v(signal, kind)),
fnd AS (SELECT r.signal, r.key, r.kind, p.id AS paragraph_id FROM r JOIN p ON p.fp = r.key WHERE r.signal <> 'length'
  UNION SELECT r.signal, r.key, r.kind, unnest(dc.ids) FROM r JOIN dc ON CAST(dc.id AS VARCHAR) = r.key WHERE r.signal = 'length')"""

_TAGS = f"""{_CL}, tg AS (SELECT label_proposed AS label, CASE words % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS status, cluster_id AS key
  FROM cl WHERE label_proposed IS NOT NULL)"""

_TOPICS = f"""{_TAGS}, want AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(q.TOPICS))}) AS v(ord, topic)),
hit AS (SELECT ord, topic, arg_min(label, key) FILTER (status = 'confirmed') AS sure, arg_min(label, key) FILTER (status = 'proposed') AS maybe
  FROM want LEFT JOIN tg ON contains(lower(label), lower(topic)) OR contains(lower(topic), lower(label)) GROUP BY ord, topic),
chk AS (SELECT topic, CASE WHEN sure IS NOT NULL THEN 'PASS' WHEN maybe IS NOT NULL THEN 'UNVERIFIED'
  WHEN (SELECT count(*) FROM tg WHERE status = 'confirmed') = 0 THEN 'NOT GRADED' ELSE 'FAIL' END AS verdict, coalesce(sure, maybe) AS label FROM hit)"""

_DUP = f"""{_GROUPS}, dup AS (SELECT CAST(coalesce(sum(copies), 0) AS BIGINT) AS repeated FROM (SELECT fp, copies FROM d UNION SELECT fp, copies FROM w)),
tot AS (SELECT count(*) AS paragraphs, sum(words) AS words FROM p),
pct AS (SELECT repeated, paragraphs, 100.0::DOUBLE * repeated / greatest(paragraphs, 1) AS pct, words FROM dup, tot)"""

_SIZE = f"""{_DUP}, sz AS (
  SELECT CASE WHEN words >= 500 THEN 'PASS' ELSE 'FAIL' END AS verdict, 'at least 500 words' AS requirement, CAST(words AS BIGINT) || ' words' AS note FROM pct
  UNION ALL SELECT CASE WHEN pct <= 30 THEN 'PASS' ELSE 'FAIL' END, 'repeated text at most 30%', CAST(round_even(pct, 0) AS BIGINT) || '% of paragraphs' FROM pct)"""


def oracle_sql() -> dict[str, str]:
    return {
        "paragraph_split": f"WITH {_BLOCKS} SELECT doc_id, CAST(position AS BIGINT) AS position, fp, words FROM b",
        "dense_paragraph_ids": f"WITH {_BLOCKS} SELECT CAST(row_number() OVER (ORDER BY doc_id, position) - 1 AS BIGINT) AS id, doc_id, CAST(position AS BIGINT) AS position FROM b",
        "fingerprint_words": f"SELECT doc_id, fp, words, preview, CAST(floor(words * 1.3) AS BIGINT) AS tokens FROM (SELECT doc_id, {_measures()}, substr({_collapsed('text')}, 1, 48) AS preview FROM documents WHERE text IS NOT NULL)",
        "corpus_size": f"WITH {_P} SELECT count(DISTINCT source) AS files, count(*) AS paragraphs, CAST(coalesce(sum(words), 0) AS BIGINT) AS words FROM p",
        "source_totals": f"WITH {_P} SELECT source, count(*) AS paragraphs, CAST(sum(words) AS BIGINT) AS words FROM p GROUP BY source",
        "exact_dupes": f"WITH {_GROUPS} SELECT fp, severity, copies, n_sources, first_id, message FROM d",
        "boilerplate": f"WITH {_GROUPS} SELECT fp, severity, copies, n_sources, first_id, message, share FROM w",
        "duplication_pct": f"WITH {_DUP} SELECT repeated, paragraphs, pct FROM pct",
        "chunk_pack": f"WITH RECURSIVE {_PACK} SELECT doc_id, chunk, fp, words, first_position, paragraphs FROM c WHERE words >= {_C.min_words}",
        "length_outliers": f"""WITH RECURSIVE {_PACK} SELECT doc_id, chunk, words, problem, 'chunk ' || problem || ' (' || words || ' words) in ' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || ': "' || substr({_collapsed('text')}, 1, 40) || '..."' AS message
            FROM (SELECT *, CASE WHEN words < {_C.length_short} THEN 'too short' ELSE 'too long' END AS problem FROM c WHERE words >= {_C.min_words} AND (words < {_C.length_short} OR words > {_C.length_long}))""",
        "domain_chunks": f"""WITH RECURSIVE {_P}, {_DOMAIN} SELECT id, source, fp, words, CAST(paragraphs AS BIGINT) AS paragraphs FROM dc""",
        "near_dupes": f"WITH {_pairs(q.PAIR_COSINE)} SELECT a, b, round(score, 4) AS score, CASE WHEN score >= 0.97 THEN 'medium' ELSE 'low' END AS severity FROM s",
        "generic": f"WITH {_centre()} SELECT vec_id, round(list_dot_product(v, c), 4) AS score FROM u, z WHERE list_dot_product(v, c) >= {q.CENTRE_COSINE} AND (SELECT count(*) FROM u) >= 4",
        "vector_topk": f"""WITH {_E}, y AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.vec_id % 100 = 0),
            z AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM y)
            SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(s, 4) AS score FROM z WHERE rank <= {_C.top_k}""",
        "embedding_cache_miss": f"WITH {_P} SELECT fp, arg_min(words, id) AS words FROM p WHERE words >= 10 AND fp NOT IN (SELECT fp FROM vectors WHERE model = '{q.MODEL}' AND kind = 'paragraph' AND fp IS NOT NULL) GROUP BY fp",
        "known_fp_check": f"WITH {_P} SELECT DISTINCT fp FROM p WHERE batch > 0 AND fp NOT IN (SELECT fp FROM p WHERE batch = 0)",
        "staleness": f"""WITH {_P}, a AS (SELECT DISTINCT fp FROM p), b AS (SELECT DISTINCT fp FROM p WHERE batch < 5)
            SELECT (SELECT count(*) FROM a WHERE fp NOT IN (SELECT fp FROM b)) AS added, (SELECT count(*) FROM b WHERE fp NOT IN (SELECT fp FROM a)) AS removed,
              (SELECT count(*) FROM ((SELECT fp FROM a EXCEPT SELECT fp FROM b) UNION (SELECT fp FROM b EXCEPT SELECT fp FROM a))) AS changed""",
        "round_robin_sample": f"""WITH c AS (SELECT id, max(source) AS source, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id), m AS (SELECT id, source, {_measures()} FROM c),
            t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS turn FROM m),
            o AS (SELECT *, row_number() OVER (ORDER BY turn, string_split(source, '/'), source) AS ord FROM t),
            w AS (SELECT *, coalesce(sum(words) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
            SELECT id, source, CAST(ord AS BIGINT) AS ord, words FROM w WHERE ord <= 12 AND before < 900""",
        "label_sample": f"""WITH {_centre('label')}, r AS (SELECT vec_id, u.label, round(list_dot_product(v, c), 4) AS score, CAST(vec_id % 200 + 20 AS BIGINT) AS words FROM u JOIN z ON u.label = z.label),
            n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM r),
            w AS (SELECT *, CAST(sum(words) OVER (PARTITION BY label ORDER BY rn) AS BIGINT) AS running_words FROM n)
            SELECT label, vec_id, score, CAST(rn AS BIGINT) AS rn, running_words FROM w WHERE rn <= 6 AND (rn = 1 OR running_words <= 600)""",
        "snippet_resolve": f"WITH {_P}, {_CL}, n AS (SELECT id, lower({_collapsed('text')}) AS norm FROM p), s AS (SELECT cluster_id, lower({_collapsed('representative')}) AS snip FROM cl) SELECT DISTINCT cluster_id AS snippet_id, id AS paragraph_id FROM s JOIN n ON contains(norm, snip) WHERE snip <> ''",
        "bench_score": f"""WITH RECURSIVE {_TRUTH},
            truth AS (SELECT res.id, det.signal, res.kind, res.paragraph_id FROM res JOIN det ON det.kind = res.kind),
            pl AS (SELECT det.signal, count(DISTINCT id) AS planted FROM def JOIN det ON det.kind = def.kind GROUP BY 1),
            ev AS (SELECT signal, count(DISTINCT key) AS n FROM fnd GROUP BY 1),
            tr AS (SELECT f.signal, count(DISTINCT key) AS tp FROM fnd f JOIN truth t ON f.signal = t.signal AND f.kind = t.kind AND f.paragraph_id = t.paragraph_id GROUP BY 1),
            hi AS (SELECT t.signal, count(DISTINCT id) AS found FROM fnd f JOIN truth t ON f.signal = t.signal AND f.kind = t.kind AND f.paragraph_id = t.paragraph_id GROUP BY 1),
            al AS (SELECT det.signal, coalesce(planted, 0) AS planted, coalesce(found, 0) AS found, coalesce(tp, 0) AS tp, coalesce(n, 0) AS n
              FROM det LEFT JOIN pl ON pl.signal = det.signal LEFT JOIN ev ON ev.signal = det.signal LEFT JOIN tr ON tr.signal = det.signal LEFT JOIN hi ON hi.signal = det.signal)
            SELECT signal, planted, found, tp, n - tp AS fp, planted - found AS missed,
              CASE WHEN n = 0 THEN NULL ELSE tp::DOUBLE / n END AS precision, CASE WHEN planted = 0 THEN NULL ELSE found::DOUBLE / planted END AS recall FROM al""",
        "bench_defect_level": f"""WITH RECURSIVE {_TRUTH}, gr AS (SELECT DISTINCT id FROM def WHERE kind IN (SELECT kind FROM det)),
            hi AS (SELECT DISTINCT res.id FROM res JOIN fnd f ON f.kind = res.kind AND f.paragraph_id = res.paragraph_id WHERE res.id IN (SELECT id FROM gr))
            SELECT (SELECT count(*) FROM gr) AS graded, (SELECT count(*) FROM hi) AS found, (SELECT count(*) FROM gr) - (SELECT count(*) FROM hi) AS missed,
              (SELECT count(*) FROM def) - (SELECT count(*) FROM gr) AS unclaimed""",
        "threshold_sweep": f"WITH {_pairs(min(q.SWEEP))}, vals AS (SELECT * FROM (VALUES {', '.join(f'({v}::DOUBLE)' for v in q.SWEEP)}) AS x(value)) SELECT value, count(score) AS hits FROM vals LEFT JOIN s ON score >= value GROUP BY value",
        "findings_ranked": f"WITH RECURSIVE {_FINDINGS} SELECT * FROM r ORDER BY {_RANK}, signal, message, key",
        "findings_summary": f"WITH RECURSIVE {_FINDINGS} SELECT severity, count(*) AS findings FROM r GROUP BY severity",
        "findings_flagged": f"WITH RECURSIVE {_FINDINGS} SELECT DISTINCT p.id AS paragraph_id FROM p JOIN r ON r.key = p.fp WHERE severity IN ('high', 'medium')",
        "findings_top_per_signal": f"""WITH RECURSIVE {_FINDINGS}, t AS (SELECT signal, key, row_number() OVER (PARTITION BY signal ORDER BY {_RANK}, message, key) AS shown, count(*) OVER (PARTITION BY signal) AS n FROM r)
            SELECT signal, key, CAST(shown AS BIGINT) AS shown, CAST(greatest(n - 4, 0) AS BIGINT) AS more FROM t WHERE shown <= 4""",
        "tag_merge": f"""WITH {_TAGS}, kept AS (SELECT * FROM tg WHERE status <> 'proposed'),
            new AS (SELECT upper(label) AS label, key FROM tg UNION ALL SELECT 'new ' || label, '' FROM tg)
            SELECT 'topic' AS "group", label, status, key FROM kept
            UNION ALL SELECT 'topic', label, 'proposed', key FROM new WHERE lower(label) NOT IN (SELECT lower(label) FROM kept) AND (key = '' OR key NOT IN (SELECT key FROM kept))""",
        "topic_checks": f"WITH {_TOPICS} SELECT topic, verdict, label FROM chk",
        "passport_checks": f"WITH {_SIZE} SELECT verdict, requirement, note FROM sz",
        "passport_verdict": f"""WITH {_SIZE}, {_TOPICS}, old AS (SELECT DISTINCT fp FROM p WHERE batch < 5),
            stale AS (SELECT (SELECT count(DISTINCT fp) FROM p WHERE fp NOT IN (SELECT fp FROM old)) + (SELECT count(*) FROM old WHERE fp NOT IN (SELECT fp FROM p)) AS n),
            v AS (SELECT verdict FROM sz UNION ALL SELECT CASE WHEN (SELECT n FROM stale) > 0 THEN 'NOT GRADED' ELSE verdict END FROM chk)
            SELECT CASE WHEN count(*) FILTER (verdict = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (verdict IN ('UNVERIFIED', 'NOT GRADED')) > 0 THEN 'INCOMPLETE' ELSE 'PASS' END AS verdict,
              count(*) FILTER (verdict IN ('UNVERIFIED', 'NOT GRADED')) AS waiting FROM v""",
        "topic_coverage": f"""WITH {_P}, {_CL}, m AS (SELECT DISTINCT cluster_id, unnest(paragraphs) AS id FROM cl), tot AS (SELECT sum(words) AS total FROM p)
            SELECT cluster_id AS "cluster", count(*) AS paragraphs, CAST(sum(words) AS BIGINT) AS words, count(DISTINCT source) AS n_sources,
              CAST(round_even(100.0::DOUBLE * sum(words)::DOUBLE / greatest(any_value(total), 1), 1) AS DOUBLE) AS pct_words FROM m JOIN p ON p.id = m.id, tot GROUP BY cluster_id""",
        "cluster_ids": f"""WITH {_P}, {_CL}, m AS (SELECT cluster_id, unnest(paragraphs) AS id FROM cl)
            SELECT cluster_id AS "cluster", substr(sha256(string_agg(fp, '' ORDER BY fp)), 1, 8) AS cluster_id FROM m JOIN p ON p.id = m.id GROUP BY cluster_id""",
        "near_dupe_findings": f"""WITH c AS (SELECT id, max(source) AS source, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id), m AS (SELECT *, {_measures()} FROM c),
            {_cached('chunk')}, h AS (SELECT m.id, m.source, m.fp, m.text, vv.v FROM m JOIN vv ON vv.fp = m.fp),
            k AS (SELECT v, min(id) AS class_id FROM h GROUP BY v), n AS (SELECT class_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM k),
            s AS (SELECT a.class_id AS a, b.class_id AS b, list_dot_product(a.v, b.v) AS score FROM n a JOIN n b ON a.class_id < b.class_id AND list_dot_product(a.v, b.v) >= {q.NEAR}
              UNION ALL SELECT k.class_id, h.id, 1.0 FROM h JOIN k ON k.v = h.v WHERE h.id <> k.class_id)
            SELECT s.a || '-' || s.b AS key, CASE WHEN score >= 0.97 THEN 'medium' ELSE 'low' END AS severity,
              printf('%.3f', score) || ' similar: ' || x.source || ' <-> ' || y.source || ' -- "' || substr({_collapsed('x.text')}, 1, 40) || '..."' AS message,
              CAST(CASE WHEN x.source = y.source THEN 1 ELSE 2 END AS BIGINT) AS n_sources FROM s JOIN m x ON x.id = s.a JOIN m y ON y.id = s.b""",
        "generic_findings": f"""WITH {_P}, {_cached('paragraph')}, h AS (SELECT p.id, p.text, list_transform(vv.v, lambda x: x / sqrt(list_dot_product(vv.v, vv.v))) AS v FROM p JOIN vv ON vv.fp = p.fp WHERE p.words >= 10),
            x AS (SELECT pos, avg(val) AS m FROM (SELECT unnest(v) AS val, unnest(range(len(v))) AS pos FROM h) GROUP BY pos), y AS (SELECT list(m ORDER BY pos) AS m FROM x),
            z AS (SELECT list_transform(m, lambda t: t / sqrt(list_dot_product(m, m))) AS c FROM y)
            SELECT CAST(id AS VARCHAR) AS key, 'medium' AS severity, 'reads like every other document (' || printf('%.3f', list_dot_product(v, c)) || ' to corpus centre): "' || substr({_collapsed('text')}, 1, 46) || '..."' AS message
            FROM h, z WHERE list_dot_product(v, c) >= {q.GENERIC}""",
        "topic_lines": f"""WITH {_TAGS}, l AS (SELECT key, max(label) AS label, max(status) AS status FROM tg WHERE key < '8' GROUP BY key)
            SELECT cl.cluster_id, CASE WHEN l.status IN ('confirmed', 'proposed') THEN l.label WHEN coalesce(label_proposed, '') <> '' THEN label_proposed ELSE '(unnamed)' END AS label,
              CASE WHEN l.status IN ('confirmed', 'proposed') THEN l.status WHEN coalesce(label_proposed, '') <> '' THEN 'proposed' ELSE 'unnamed' END AS standing FROM cl LEFT JOIN l ON l.key = cl.cluster_id""",
        "near_dupe_links": f"""WITH v AS (SELECT fp, list_transform(any_value(vec), lambda x: x::DOUBLE) AS v FROM vectors WHERE model = '{q.MODEL}' AND kind = 'chunk' AND fp IS NOT NULL
              AND len(vec) = 128 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY fp),
            k AS (SELECT v, min(fp) AS class_id FROM v GROUP BY v),
            n AS (SELECT class_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM k),
            l AS (SELECT a.class_id, count(*) AS links FROM n a JOIN n b ON a.class_id <> b.class_id AND list_dot_product(a.v, b.v) >= {_C.near_duplicate} GROUP BY a.class_id)
            SELECT v.fp, k.class_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM v JOIN k ON k.v = v.v LEFT JOIN l ON l.class_id = k.class_id""",
    }
