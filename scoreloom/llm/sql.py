"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from scoreloom.llm.licenses import BASE, TEMPLATES
from scoreloom.llm.shards import SEED

#: The reflected polynomial of CRC-32, and its start.
_POLYNOMIAL, _START = 3988292384, 4294967295


_CRC_TABLE = f"""crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END) AS v
    FROM range(256) AS r(n)))"""


def merkle(levels: int = 14, top_levels: int = 8) -> str:
    """Trees level by level with every hash anew; enough levels for 3 ** 14 documents of a source and 3 ** 8 sources."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"

    def chain(stem: str, count: int) -> list[str]:
        out = []
        for k in range(count):
            up = f"{stem}{k}"
            out.append(f"""{up}s AS (
  SELECT a.key, a.pos, a.n, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM {up} a JOIN {up} b ON a.key = b.key AND a.pos // 3 = b.pos // 3 GROUP BY a.key, a.pos, a.n),
{stem}{k + 1} AS (
  SELECT key, pos // 3 AS pos, max((n + 2) // 3) AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM {up} GROUP BY key, pos // 3)""")
        return out

    def fold(stem: str, count: int, first: str) -> list[str]:
        out, last = [], first
        for k in range(count):
            out.append(f"""{stem}f{k} AS (
  SELECT f.row, f.key, f.pos // 3 AS pos, f.proof || s.before || s.after AS proof,
         CASE WHEN s.n = 1 THEN f.h ELSE sha256(s.before || f.h || s.after) END AS h
  FROM {last} f JOIN {stem}{k}s s USING (key, pos))""")
            last = f"{stem}f{k}"
        return out

    own = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [
        _CRC_TABLE,
        f"""hashed AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, sha256({own} || {field("text")}) AS leaf,
         sha256({own} || {field("replace(text, chr(10), '')")}) AS changed,
         list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents)""",
        f"""leaves AS (
  SELECT doc_id, source, key, leaf,
         CASE WHEN xor(list_reduce(list_prepend({_START}::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), {_START}) % 2 = 0
              THEN changed ELSE leaf END AS later,
         row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n,
         row_number() OVER () AS row
  FROM hashed, crc_table)""",
        "a0 AS (SELECT key, pos, n, leaf AS h FROM leaves)",
        *chain("a", levels),
        f"sub AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS n FROM a{levels})",
        "b0 AS (SELECT '' AS key, place AS pos, n, subroot AS h FROM sub)",
        *chain("b", top_levels),
        "start AS (SELECT row, key, pos, '' AS proof, later AS h FROM leaves)",
        *fold("a", levels, "start"),
        f"turn AS (SELECT f.row, '' AS key, place AS pos, proof, h FROM af{levels - 1} f JOIN sub USING (key))",
        *fold("b", top_levels, "turn"),
    ]
    return f"""
WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, b{top_levels}.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = b{top_levels}.h AS verified, source
FROM leaves JOIN sub ON leaves.key = sub.key JOIN bf{top_levels - 1} f ON leaves.row = f.row, b{top_levels}"""


def warc() -> str:
    """Records by payload; base 32 from the hex digest, four letters for every five hex digits."""
    return """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM page"""


def sharding(shards: int = 8) -> str:
    """Ranks by plain windows, and CRC-32 byte by byte with a table computed from its polynomial."""
    return f"""
WITH crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END) AS v
    FROM range(256) AS r(n))),
hexed AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
listed AS (
  SELECT doc_id, source, n_bytes, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM hexed),
sized AS (
  SELECT doc_id, source, n_bytes + 1 AS size,
         xor(list_reduce(list_prepend({_START}::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), {_START}) AS text_crc32,
         md5('{SEED}/' || coalesce(doc_id::VARCHAR, 'none')) AS h
  FROM listed, crc_table),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) AS r, count(*) OVER (PARTITION BY source) AS n
  FROM sized),
placed AS (
  SELECT *, row_number() OVER (
    ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, h, doc_id NULLS FIRST, size, text_crc32) - 1 AS p, count(*) OVER () AS total
  FROM ranked),
cut AS (
  SELECT *, total // {shards} AS small, total % {shards} AS longer FROM placed),
dealt AS (
  SELECT *, CASE WHEN p < longer * (small + 1) THEN p // (small + 1) ELSE longer + (p - longer * (small + 1)) // greatest(small, 1) END AS shard FROM cut)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(p - shard * small - least(shard, longer) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM dealt"""


def licenses() -> str:
    """Phrases as a join of word places with phrase words by the start they imply."""
    rows, n_phrases = [], {}
    for label, phrases in [*BASE.items(), *TEMPLATES.items()]:
        n_phrases[label] = len(phrases)
        for k, phrase in enumerate(phrases):
            words = phrase.split()
            rows += [f"('{label}', {k}, {len(words)}, {j}, '{w}', {str(label in BASE).lower()})" for j, w in enumerate(words)]
    labels = ", ".join(f"('{label}', {n})" for label, n in n_phrases.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH phrase(label, k, n, j, word, base) AS (VALUES {', '.join(rows)}),
template(label, n_phrases) AS (VALUES {labels}),
file AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
token AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM file),
hit AS (SELECT * FROM token WHERE word IN (SELECT word FROM phrase)),
idf AS (
  SELECT word, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(DISTINCT doc_id))) + 1 AS x FROM hit GROUP BY word),
start AS (
  SELECT doc_id, label, k, n, base, i - j AS s FROM hit JOIN phrase USING (word) GROUP BY doc_id, label, k, n, base, i - j HAVING count(*) = n),
found AS (
  SELECT doc_id, label FROM start JOIN template USING (label) GROUP BY doc_id, label, n_phrases HAVING count(DISTINCT k) = n_phrases),
base AS (
  SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM start WHERE base GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM found GROUP BY doc_id),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM start JOIN found USING (doc_id, label)),
weighed AS (
  SELECT doc_id, sum(x) AS total, sum(CASE WHEN covered.i IS NOT NULL THEN x ELSE 0 END) AS inside
  FROM hit JOIN idf USING (word) LEFT JOIN covered USING (doc_id, i) GROUP BY doc_id),
rare AS (
  SELECT doc_id, first(word ORDER BY x DESC, word) AS rarest_word FROM hit JOIN idf USING (word) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(inside / total, 0.0), 6) AS score, rarest_word
FROM file LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN weighed USING (doc_id) LEFT JOIN rare USING (doc_id)"""
