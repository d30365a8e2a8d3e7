"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tidemark.llm import bpe, decontam, html_main, licenses, line_dedup, minhash, negatives, pii, quality, search, substrings, urls, warc


def _over(job, *tables: str):
    """A query that applies ``job`` to whole tables."""
    return lambda spark, sf_dir: job(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


JOBS = {
    "op1_minhash": _over(minhash.report, "documents"),
    "op2_html": _over(html_main.report, "pages"),
    "op3_decontam": _over(decontam.report, "documents", "benchmark"),
    "op4_warc": _over(warc.report, "pages"),
    "op5_pii": _over(pii.report, "documents"),
    "op6_bpe": _over(bpe.report, "documents"),
    "op7_substrings": _over(substrings.report, "documents"),
    "op8_line_dedup": _over(line_dedup.report, "documents"),
    "op9_licenses": _over(licenses.report, "documents"),
    "op10_quality": _over(quality.report, "documents", "labels"),
    "op11_negatives": _over(negatives.report, "embeddings"),
    "op12_search": _over(search.report, "documents", "benchmark"),
    "op13_urls": _over(urls.report, "pages"),
}

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

ORACLES: dict[str, str] = {
    "op11_negatives": """
        WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT a.r, a.vec_id AS anchor_id, a.label, b.vec_id AS id, b.label AS other, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
              FROM e a, e b WHERE a.vec_id % 100 = 0),
        q AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score FROM p WHERE label = other AND id <> anchor_id
              QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5)
        SELECT q.anchor_id, q.positive_id, CAST(row_number() OVER (PARTITION BY r, q.positive_id ORDER BY p.score DESC, p.id) AS INTEGER) AS rank,
               p.id AS negative_id, q.positive_score, p.score AS negative_score
        FROM q JOIN p USING (r) WHERE p.label <> p.other AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
    "op12_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
        i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark),
        s AS (SELECT count(*) AS total, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
        q AS (SELECT item, item_id, t.term, count(*) AS times FROM i, unnest(w) t(term) GROUP BY ALL),
        f AS (SELECT r, t.term, count(*) AS tf FROM d, unnest(w) t(term) WHERE t.term IN (SELECT term FROM q) GROUP BY ALL),
        g AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, s GROUP BY term),
        h AS (SELECT r, doc_id, 100 - 25 + ((25 * len(w) * total) // terms) AS m FROM d, s WHERE len(w) > 0),
        c AS (SELECT item, item_id, h.r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
              FROM q JOIN f USING (term) JOIN g USING (term) JOIN h ON h.r = f.r GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM c WHERE score > 0 QUALIFY rank <= 20""",
    "op3_decontam": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w FROM benchmark),
        s AS (SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
        iw AS (SELECT item, item_id, n, k AS inside, array_to_string(w[k:k + n - 1], ' ') AS win FROM s, unnest(range(1, len(w) - n + 2)) t(k)),
        ns AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM d, ns, unnest(range(1, len(w) - n + 2)) t(k)),
        m AS (SELECT r, dw.n, k, item, item_id, inside FROM dw JOIN iw USING (n, win)),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, n, k FROM m) x, unnest(range(k, k + n)) t(p) GROUP BY r),
        g AS (SELECT r, item, k, n, k - row_number() OVER (PARTITION BY r, item, k - inside ORDER BY k) AS run, k - inside AS diagonal FROM m),
        l AS (SELECT r, max(len) AS longest FROM (SELECT r, max(k) - min(k) + max(n) AS len FROM g GROUP BY r, item, diagonal, run) x GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(c, ',' ORDER BY c) AS ids
              FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS c FROM m WHERE item_id IS NOT NULL) x GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN l USING (r)""",
    "op4_warc": """
        WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, url, octet_length(body) AS n, sha1(body) AS digest FROM p),
        f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to, coalesce(url, '') AS url
        FROM f""",
    "op8_line_dedup": """
        WITH s AS (SELECT doc_id, text, CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
        l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS raw FROM s),
        c AS (SELECT doc_id, pos, coalesce(CAST(doc_id AS HUGEINT), 99999999999999999999) * 2147483648 + pos AS o,
                     string_split(trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), ' ') AS w FROM l),
        e AS (SELECT *, len(w) AS n FROM c WHERE len(w) >= 8),
        v AS (SELECT o, j, hash(array_to_string(list_concat(w[1:j], w[j + 2:]), ' ')) AS k FROM e, unnest(range(0, n)) t(j)
              UNION ALL SELECT o, j, hash(array_to_string(w, ' ')) FROM e, unnest(range(0, n + 1)) t(j)),
        f AS (SELECT j, k, min(o) AS first FROM v GROUP BY j, k),
        g AS (SELECT DISTINCT o FROM v JOIN f USING (j, k) WHERE o > first),
        r AS (SELECT l.doc_id, count(*) FILTER (g.o IS NOT NULL) AS n_removed, string_agg(raw, chr(10) ORDER BY l.pos) FILTER (g.o IS NULL) AS kept
              FROM l LEFT JOIN g ON g.o = coalesce(CAST(l.doc_id AS HUGEINT), 99999999999999999999) * 2147483648 + l.pos GROUP BY l.doc_id)
        SELECT s.doc_id, len(lines) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM s LEFT JOIN r ON r.doc_id IS NOT DISTINCT FROM s.doc_id""",
}
