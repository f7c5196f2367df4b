"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm.decontaminate import op2_benchmark_decontamination
from tessera.llm.importance import op13_importance_resampling
from tessera.llm.jaccard import op4_ngram_jaccard_join
from tessera.llm.licenses import op9_license_scans
from tessera.llm.linededup import op1_line_dedup
from tessera.llm.media import op3_media_columns
from tessera.llm.packing import op10_best_fit_packing
from tessera.llm.pii import op8_pii
from tessera.llm.quality import op6_quality_classifier
from tessera.llm.secrets import op12_secret_scans
from tessera.llm.tokencount import op7_token_counts
from tessera.llm.tokenfile import op5_token_id_output
from tessera.llm.variants import op11_spelling_variants

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_benchmark_decontamination, op3_media_columns, op4_ngram_jaccard_join, op5_token_id_output, op6_quality_classifier, op7_token_counts,
        op8_pii, op9_license_scans, op10_best_fit_packing, op11_spelling_variants, op12_secret_scans, op13_importance_resampling,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PIECES = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t)"


def _crc32(text: str) -> str:
    """DuckDB's SQL for the unsigned crc32 of a text's UTF-8 bytes; crc is in scope."""
    byte = f"list_transform(range(strlen({text})), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce({byte}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


#: Others train models, encode by a library or hash binary files; tests/llm compares them with brute force.
SQL = {
    "op2_benchmark_decontamination": f"""WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[k + 1 : k + n], ' ') AS x FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS k FROM it WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM d),
l AS (SELECT doc_id, k, list(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM p),
hits AS (SELECT doc_id, k, n, item FROM (SELECT doc_id, k, ns.n, array_to_string(ws[1 : ns.n], ' ') AS x FROM l, (SELECT DISTINCT n FROM win) ns WHERE len(ws) >= ns.n) JOIN win USING (n, x)),
cov AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM hits) GROUP BY doc_id), its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_PIECES} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM d),
l AS (SELECT doc_id, list(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ws FROM p),
sh AS (SELECT DISTINCT doc_id, ws AS s FROM l WHERE len(ws) = 5 UNION SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 4), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL), e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e2.b FROM r JOIN e2 ON r.o = e2.a)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op11_spelling_variants": f"""WITH RECURSIVE {_CRC_TABLE}, r0 AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r0 WHERE length(run) >= 6),
h AS (SELECT run, n, CAST(h % length(run) AS BIGINT) AS p, h % 199 = 0 AS cut FROM (SELECT run, n, {_crc32("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run), crc)),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN cut THEN substr(run, 1, p) || substr(run, p + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS k FROM v)),
pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM del a JOIN del b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM del a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM del a JOIN v b ON a.rest = b.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN near END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN (SELECT word, count(*) AS n_near, max(n) AS m, arg_min(near, (-n, near)) AS near FROM pairs GROUP BY word) USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN f ON w.next = f.word)
SELECT f.word, form, root, f.n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND next IS NULL""",
    "op13_importance_resampling": f"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, {_WORDS} AS w FROM documents), f AS (SELECT doc_id, unnest(w) AS word FROM d), g AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
v AS (SELECT word, {_crc32('word')} % 10000 AS b FROM (SELECT word FROM f UNION SELECT word FROM g), crc),
s AS (SELECT b, count(*) AS s FROM f JOIN v USING (word) GROUP BY b), t AS (SELECT b, count(*) AS t FROM g JOIN v USING (word) GROUP BY b), sums AS (SELECT (SELECT count(*) FROM f) AS sa, (SELECT count(*) FROM g) AS ta),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (sa + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (ta + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), sums),
w AS (SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN v USING (word) JOIN gain USING (b) GROUP BY doc_id),
sc AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM sc LEFT JOIN r USING (doc_id)""",
}
