"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm.embeddings import op1_int8_tiles
from tessera.llm.jaccard import op3_universe_partition
from tessera.llm.license_scan import op6_containment
from tessera.llm.mixing import op7_soft_membership
from tessera.llm.packing import op10_exact_complement
from tessera.llm.phrases import op9_phrase_automata
from tessera.llm.quality import op5_robust_outliers
from tessera.llm.sharding import op4_jump_hash
from tessera.llm.url_rules import op2_association_rules
from tessera.llm.warc import op8_warc

QUERIES = {f.__name__: f for f in (op1_int8_tiles, op2_association_rules, op3_universe_partition, op4_jump_hash, op5_robust_outliers, op6_containment, op7_soft_membership, op8_warc, op9_phrase_automata, op10_exact_complement)}

#: Components by the transitive closure of ``links (a, b)``, both ways; for small inputs.
_REACH = "reach (a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"

_OP1 = f"""WITH RECURSIVE sound AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9), {_REACH},
    least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
    FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

_OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 2)), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM w WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
    GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))), {_REACH}, least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id"""

_OP8 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN g USING (payload_digest)"""

_OP9 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
    x AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w)),
    f AS (SELECT x, min((doc_id, s)) AS f FROM x GROUP BY x HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM x JOIN f USING (x) WHERE f <> (doc_id, s)),
    g AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
    sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: g IS NULL OR NOT list_contains(g, i)), lambda i: w[i]), ' ')) AS kept_sha256
    FROM w LEFT JOIN g USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op1_int8_tiles": _OP1, "op3_universe_partition": _OP3, "op8_warc": _OP8, "op9_phrase_automata": _OP9}
