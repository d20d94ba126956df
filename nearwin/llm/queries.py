"""The queries of this package, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from nearwin.llm import arrowstream, conversations, fingerprints, langid, media, mixing, packing, phrases, sharding, simhash, spans, topk, toxicity
from nearwin.llm.tables import table


def tokenizer_path() -> str:
    """The vocabulary file named in the contracts; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_sharding(spark, sf_dir):
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_arrow_stream(spark, sf_dir):
    return arrowstream.token_places(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_langid(spark, sf_dir):
    return langid.language_of(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_sentence_spans(spark, sf_dir):
    return spans.span_dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op1_multiset_hash(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op4_progressive_jpeg(spark, sf_dir):
    return media.media_digests(table(spark, sf_dir, "documents"))


def op11_exact_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"))


def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)


def op13_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


_ALL = (
    op1_multiset_hash, op2_sharding, op3_toxicity, op4_progressive_jpeg, op5_sentence_spans, op6_arrow_stream, op7_simhash, op8_mixing,
    op9_langid, op10_packing, op11_exact_topk, op12_conversation_repair, op13_collocations,
)
QUERIES = {f.__name__: f for f in _ALL}

#: For op8: targets by the level of words per unit of weight, the golden-ratio slots of 256 words, and what each pass over
#: a source takes of a document (by its place among the source's shuffled words) and in which slot first.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][src % 3 + 1] AS weight, source_size * 2 AS room, source_size * 2 / [3, 1, 2][src % 3 + 1] AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(room) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT src, source, source_size, least(room::DOUBLE, (SELECT arg_min(level, (ratio, src)) FROM l WHERE level <= ratio) * weight) AS target FROM l
), u AS (
  SELECT *, floor(target + 0.5)::BIGINT AS words, ceil(source_size / 256)::BIGINT AS blocks, sum(target) OVER () AS total FROM t
), k AS (
  SELECT *, CASE WHEN words > source_size AND source_size > 0
      THEN words // source_size * blocks + ceil(words % source_size / 256)::BIGINT ELSE ceil(words / 256)::BIGINT END AS need,
    sum(target / total) OVER (ORDER BY src) AS upto FROM u
), g AS (
  SELECT i AS slot, ((i // 1048576) * (0.6180339887498949::DOUBLE * 1048576 % 1.0) + (i % 1048576) * 0.6180339887498949::DOUBLE) % 1.0 AS point
  FROM range((SELECT sum(need)::BIGINT FROM k)) AS r(i)
), drawn AS (
  SELECT slot, (SELECT count(*) FROM k WHERE upto <= point AND src < (SELECT max(src) FROM k)) AS src FROM g
), ranked AS (
  SELECT src, slot, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM drawn
), slots AS (
  SELECT src, slot, rank FROM ranked JOIN k USING (src) WHERE rank < need
  UNION ALL
  SELECT src, (SELECT sum(need)::BIGINT FROM k), unnest(range(have, need)) FROM (
    SELECT src, need, (SELECT count(*) FROM ranked r WHERE r.src = k.src) AS have FROM k)
), p AS (
  SELECT d.doc_id, d.size, k.src, k.source_size, k.target, k.words, k.blocks,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lead_words
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
), f AS (
  SELECT p.doc_id, min(slot) AS first_slot
  FROM p JOIN slots ON p.src = slots.src AND rank % blocks BETWEEN lead_words // 256 AND (lead_words + size - 1) // 256
  WHERE size > 0 AND greatest(lead_words, rank % blocks * 256) < words - rank // blocks * source_size
  GROUP BY p.doc_id
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, words - lead_words)) + greatest(0, least(size, words - source_size - lead_words)))::BIGINT AS taken, first_slot
FROM p LEFT JOIN f USING (doc_id)
"""

#: For op11: components as whole numbers in doubles, in which their sums of products are exact.
OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id IS DISTINCT FROM v.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

#: For op12: crc32 bit by bit over the key's characters; from the last turn on, for each grammar state (0 nothing, 1 after
#: s, 2 after u, 3 after ua) the least (cost, letters) with the lines that they leave.
_BEST = lambda keep, to, say: f"""list_min([
      {{'c': z.v[{to}].c + 2 + t.cut + t.gone, 'a': 'R' || z.v[{to}].a, 'l': list_prepend('{say}:' || t.text, z.v[{to}].l)}},
      {{'c': z.v[{keep[0]}].c + 3, 'a': 'D' || z.v[{keep[0]}].a, 'l': z.v[{keep[0]}].l}},
      {{'c': CASE WHEN {keep[1]} THEN z.v[{keep[2]}].c + t.cut + t.gone ELSE 1000000000 END, 'a': 'K' || z.v[{keep[2]}].a,
        'l': list_prepend(t.role || ':' || t.text, z.v[{keep[2]}].l)}}])"""  # noqa: E731
_INSERTED = lambda own, to, say: f"list_min([w[{own}], {{'c': w[{to}].c + 2, 'a': 'I' || w[{to}].a, 'l': list_prepend('{say}:', w[{to}].l)}}])"
_TWICE = lambda own: f"list_min([w[{own}], {{'c': w[3].c + 2, 'a': 'I' || w[3].a, 'l': list_prepend('user:', w[3].l)}}, {{'c': w[4].c + 4, 'a': 'II' || w[4].a, 'l': list_prepend('user:', list_prepend('assistant:', w[4].l))}}])"
OP12_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), fated AS (
  SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT), lambda crc, x:
    list_reduce(range(8), lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END, xor(crc, x)), 4294967295), 4294967295) % 20 AS fate
  FROM raw
), hurt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM hurt
), t AS (
  SELECT *, said = '' AS blank, said <> '' AND nth > 1 AS duplicate, said <> '' AND nth = 1 AND right(said, 1) NOT IN ('.', '!', '?') AS truncated,
    CASE WHEN said = '' OR nth > 1 THEN 1000000000 ELSE 0 END AS gone, CASE WHEN said <> '' AND nth = 1 AND right(said, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut,
    left(role, 1) AS x, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i), '') AS was FROM placed
), z AS (
  SELECT conv_id, count(*) + 1 AS i, [
    {{'c': 0, 'a': '', 'l': []::VARCHAR[]}}, {{'c': 4, 'a': 'II', 'l': ['user:', 'assistant:']}},
    {{'c': 2, 'a': 'I', 'l': ['assistant:']}}, {{'c': 0, 'a': '', 'l': []::VARCHAR[]}}] AS v FROM t GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, [{_TWICE(1)}, {_TWICE(2)}, {_INSERTED(3, 4, 'assistant')}, {_INSERTED(4, 3, 'user')}] FROM (
    SELECT z.conv_id, t.i, [
      {_BEST(("1", "t.x IN ('s', 'u')", "(CASE WHEN t.x = 's' THEN 2 ELSE 3 END)"), 3, 'user')},
      {_BEST(("2", "t.x = 'u'", "3"), 3, 'user')},
      {_BEST(("3", "t.x = 'a'", "4"), 4, 'assistant')},
      {_BEST(("4", "t.x = 'u'", "3"), 3, 'user')}] AS w
    FROM z JOIN t ON z.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = z.i - 1)
), f AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT)::BIGINT AS blank,
    sum(duplicate::INT)::BIGINT AS duplicate, sum(truncated::INT)::BIGINT AS truncated,
    sum((i > 1 AND left(was, 1) || x NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal FROM t GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.v[1].c, 0)::BIGINT AS cost, coalesce(z.v[1].a, '') AS audit,
  sha256(coalesce(array_to_string(z.v[1].l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = 1
"""

OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p
), g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(k))
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), b AS (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS x, array_to_string(w[cut + 1 : k], ' ') AS y FROM c, (VALUES (1), (2)) s(cut) WHERE cut < k
), cuts AS (
  SELECT b.lang, b.k, b.phrase, b.a, cut, x.a AS l, y.a AS r, (1000000::HUGEINT * b.a * b.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM b JOIN f x ON x.lang = b.lang AND x.phrase = b.x JOIN f y ON y.lang = b.lang AND y.phrase = b.y
), longer AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3
), around AS (
  SELECT lang, phrase, max(a) AS most FROM longer GROUP BY ALL
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), kept AS (
  SELECT least.* FROM least LEFT JOIN around ON least.lang = around.lang AND least.phrase = around.phrase
  WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON kept.lang = n.lang QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {"op8_mixing": OP8_SQL, "op11_exact_topk": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_collocations": OP13_SQL}
