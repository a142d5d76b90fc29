"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galvanite.llm import bpe, decontam, host_trust, html_text, licenses, near_dup, orchard, packing, repetition, secrets, toxicity, turns, warc_zip
from galvanite.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": lambda s, d: packing.pack_documents(table(s, d, "documents")),
    "op2_decontamination": lambda s, d: decontam.judge_documents(table(s, d, "documents"), table(s, d, "benchmark")).drop("id0", "h"),
    "op3_html_extraction": lambda s, d: html_text.extract_pages(table(s, d, "pages")),
    "op4_license_scan": lambda s, d: licenses.scan_licenses(table(s, d, "documents")),
    "op5_secret_scan": lambda s, d: secrets.scan_secrets(table(s, d, "documents")),
    "op6_minhash_near_dedup": lambda s, d: near_dup.find_groups(table(s, d, "documents")).drop("id0", "h"),
    "op7_warc_zip": lambda s, d: warc_zip.archive_round_trip(table(s, d, "pages")),
    "op8_toxicity": lambda s, d: toxicity.score_documents(table(s, d, "documents"), table(s, d, "labels")),
    "op9_quality_repetition": lambda s, d: repetition.judge_repetition(table(s, d, "documents")),
    "op10_url_filter": lambda s, d: host_trust.judge_urls(table(s, d, "pages")),
    "op11_bpe_round_trip": lambda s, d: bpe.digest_documents(table(s, d, "documents")),
    "op12_conversation_repair": lambda s, d: turns.repair_conversations(table(s, d, "conversations")),
    "op13_centroid_clustering": lambda s, d: orchard.cluster_report(table(s, d, "embeddings")),
}

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# DuckDB has no crc32: the table of 256 remainders follows from the polynomial.
_CRC = """crc_bits(i, k, v) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def _crc(text: str) -> str:
    """crc32 of an ASCII text."""
    step = "xor(c // 256, t[1 + xor(c % 256, x)])"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, x: {step}))"


def _moves(d: str, n: str) -> str:
    """Costs to go of the four states of a row from those behind it, `n`; insertions lead to another state of the same row."""
    ok, add = "CASE WHEN fault IN ('b', 'd') THEN 1000000000 ELSE 0 END", "CASE WHEN fault = 't' THEN 1 ELSE 0 END"
    keep = {0: f"CASE first WHEN 's' THEN {n}1 WHEN 'u' THEN {n}2 ELSE 1000000000 END", 1: f"CASE first WHEN 'u' THEN {n}2 ELSE 1000000000 END",
            2: f"CASE first WHEN 'a' THEN {n}3 ELSE 1000000000 END", 3: f"CASE first WHEN 'u' THEN {n}2 ELSE 1000000000 END"}
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    return ", ".join(f"least(3 + {n}{q}, {ok} + {add} + least({keep[q]}, 2 + {n}{to[q]})) AS {d}{q}" for q in range(4))


def _repair_sql() -> str:
    return f"""
WITH RECURSIVE {_CRC},
z AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
h AS (SELECT z.*, {_crc('k')} % 20 AS kind FROM z, crc_table),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS first, right(rtrim(text, {_SPACES}), 1) AS tail FROM m),
f AS MATERIALIZED (SELECT *, CASE WHEN tail = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first AS pair FROM p),
r(conv_id, i, d0, d1, d2, d3) AS (SELECT DISTINCT conv_id, n + 1, 0, 4, 2, 0 FROM f
  UNION ALL SELECT conv_id, i, least(e0, 2 + least(e2, 2 + e3)), least(e1, 2 + least(e2, 2 + e3)), least(e2, 2 + e3), least(e3, 2 + e2)
  FROM (SELECT f.conv_id, f.i, {_moves('e', 'r.d')} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i - 1)),
g AS MATERIALIZED (SELECT r.conv_id, r.i, [d0, d1, d2, d3] AS d, f.role, f.text, f.fault, f.first FROM r LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i),
w(conv_id, i, q, audit, body) AS (SELECT conv_id, CAST(1 AS BIGINT), 0, '', CAST([] AS VARCHAR[]) FROM f WHERE i = 1
  UNION ALL SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN q WHEN e = 'K' AND first = 's' THEN 1 ELSE nq END, audit || e,
    CASE e WHEN 'D' THEN body WHEN 'K' THEN list_append(body, role || ':' || text) WHEN 'R' THEN list_append(body, CASE WHEN nq = 2 THEN 'user:' ELSE 'assistant:' END || text)
      ELSE list_append(body, CASE WHEN nq = 2 THEN 'user:' ELSE 'assistant:' END) END
  FROM (SELECT w.*, g.role, g.text, g.first, [2, 2, 3, 2][w.q + 1] AS nq,
      CASE WHEN nx.d IS NOT NULL AND 3 + nx.d[w.q + 1] = g.d[w.q + 1] THEN 'D'
        WHEN 2 + g.d[[2, 2, 3, 2][w.q + 1] + 1] = g.d[w.q + 1] THEN 'I'
        WHEN nx.d IS NOT NULL AND g.fault IN ('', 't') AND ((w.q = 0 AND g.first = 's') OR (w.q <> 2 AND g.first = 'u') OR (w.q = 2 AND g.first = 'a'))
          AND (CASE WHEN g.fault = 't' THEN 1 ELSE 0 END) + nx.d[CASE WHEN g.first = 's' THEN 1 ELSE [2, 2, 3, 2][w.q + 1] END + 1] = g.d[w.q + 1] THEN 'K'
        WHEN nx.d IS NOT NULL THEN 'R' END AS e
    FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i LEFT JOIN g nx ON nx.conv_id IS NOT DISTINCT FROM w.conv_id AND nx.i = w.i + 1) WHERE e IS NOT NULL),
last AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(body, length(audit)) AS body FROM w GROUP BY conv_id),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS dup, count(*) FILTER (fault = 't') AS trunc,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(dup, 0) AS duplicate, coalesce(trunc, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(g.d[1], 0) AS BIGINT) AS cost, coalesce(last.audit, '') AS audit, sha256(coalesce(array_to_string(last.body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id AND g.i = 1 LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _cluster_sql(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    parts = [f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), x) - 1 AS INTEGER) AS c, x AS y FROM v QUALIFY c < {k})"""]
    near = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (SELECT vec_id, x, c, CAST({near} AS BIGINT) AS d FROM v, c{r}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS y FROM (SELECT c, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(j) GROUP BY c, j) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.y, c{r}.y) AS y FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(y, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} ON c{rounds}.c = a.c"""


ORACLES: dict[str, str] = {
    "op12_conversation_repair": _repair_sql(),
    "op13_centroid_clustering": _cluster_sql(),
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, s, s + 12), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, s, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op7_warc_zip": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS s FROM pages),
o AS (SELECT s, b, max(page_id) AS m FROM p WHERE b >= 1000 GROUP BY s, b)
SELECT page_id, CAST(p.b AS BIGINT) AS payload_bytes, p.s AS payload_digest, CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to FROM p LEFT JOIN o ON p.s = o.s AND p.b = o.b""",
}
