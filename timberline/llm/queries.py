"""The training-data operators as queries over the test tables, and the same in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import bpe, chat, decontam, importance, jaccard, licenses, line_dedup, merkle, neighbours, pii, quality, secrets, toxicity
from timberline.llm.common import free_name
from timberline.session import configure


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(_table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    name = free_name(docs, "deduped")
    out = line_dedup.deduplicated(docs, added=name)
    return out.select("doc_id", *[F.col(f"{name}.{c}") for c in ("text", "n_lines", "n_dropped", "depleted")])


def op4_chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    views = chat.perspectives(_table(spark, folder, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"]))
    return views.select("conv_id", "speaker", "segment", "n_turns", "text", F.array_join(spans, ",").alias("mask"))


def op5_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(_table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    scored = docs.select("doc_id", toxicity.differences(model, docs["text"], docs).alias("s"))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "s.score",
        (F.col("s.score") >= 0.3).cast("int").alias("predicted"),
    )


def _named(spans, kinds: tuple[str, ...]):
    """kind:start:end of the spans of these kinds, comma-joined."""
    own = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _counted(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def _digested(found: DataFrame, base: tuple[str, ...], every: tuple[str, ...]) -> DataFrame:
    spans = F.col("found")
    return found.select(
        "doc_id",
        *(_counted(spans, kind) for kind in base),
        F.sha2(_named(spans, base), 256).alias("base_sha256"),
        _named(spans, every).alias("spans"),
    )


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, folder, "documents"))


def op7_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = docs.select("doc_id", secrets.secret_spans(spark, docs["text"]).alias("found"))
    return _digested(found, ("assign", "access", "hex"), tuple(r.kind for r in secrets.RULES))


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    tokens = bpe.load_ranks(VOCABULARY)
    both = bpe.round_trip(docs, tokens, public_tokenizers.PATTERN, ["doc_id"])
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = docs.select("doc_id", pii.pii_spans(docs["text"]).alias("found"))
    return _digested(found, ("email", "ip", "card", "phone"), tuple(k.name for k in pii.KINDS))


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    hit = docs.select("doc_id", decontam.contamination(items, docs["text"]).alias("hit"))
    return hit.select(
        "doc_id",
        "hit.n_words",
        "hit.n_hit",
        F.size("hit.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"),
        (F.col("hit.n_hit") > 0).alias("contaminated"),
    )


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    even = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    proofs = merkle.manifest(docs, changed={"text": text})
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = neighbours.fit(docs, _table(spark, folder, "labels"))
    scored = docs.select("doc_id", neighbours.scores(model, docs["text"], docs).alias("score"))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


_CRC = r"""
  xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(encode(x)), 2 * i - 1, 2))::BIGINT FOR i IN range(1, strlen(x) + 1)]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)),
      4294967295)
"""

_OP11 = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, source, lang, n_chars, text, @CRC@ % 2 = 0 AS even
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '') AS x FROM documents)),
framed AS (
  SELECT doc_id, source, doc_id IS NOT NULL AND even AS even, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM d),
l AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other
    FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS other FROM framed))),
nodes AS (
  SELECT source, 0 AS lvl, 1::BIGINT AS width, idx, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL
  SELECT source, lvl + 1, width * 3, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY source, lvl, width, n, idx // 3),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, 1::BIGINT AS width, idx, h, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT lvl + 1, width * 3, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3
  FROM tops WHERE n > 1 GROUP BY lvl, width, n, idx // 3),
path AS (
  SELECT rid, 0 AS part, x.lvl, x.idx, x.h, l.idx // x.width AS own
  FROM l JOIN nodes x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.idx // 3 = l.idx // (x.width * 3)
  UNION ALL
  SELECT rid, 1, x.lvl, x.idx, x.h, s.idx // x.width
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN tops x ON x.n > 1 AND x.idx // 3 = s.idx // (x.width * 3)),
steps AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY part, lvl) AS k,
         coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < own), '') AS before,
         coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > own), '') AS after
  FROM path GROUP BY rid, part, lvl),
folded AS (
  SELECT rid, 1::BIGINT AS k, other AS h FROM l
  UNION ALL
  SELECT rid, k + 1, sha256(before || h || after) FROM folded JOIN steps USING (rid, k)),
proofs AS (SELECT rid, string_agg(before || after, '' ORDER BY k) AS proof FROM steps GROUP BY rid),
ends AS (SELECT rid, arg_max(h, k) AS h FROM folded GROUP BY rid)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, ends.h AS folded_root, ends.h = t.h AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN tops t ON t.n = 1 JOIN ends USING (rid) LEFT JOIN proofs USING (rid)
""".replace("@CRC@", _CRC)

_OP13 = r"""
WITH
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
dw AS (SELECT x, count(*) AS s FROM (SELECT unnest(words) AS x FROM w) GROUP BY x),
iw AS (
  SELECT x, count(*) AS t
  FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark) GROUP BY x),
b AS (SELECT x, @CRC@ % 10000 AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM dw FULL JOIN iw USING (x)),
g AS (
  SELECT bucket, floor(1000 * ln(((sum(t) + 1)::DOUBLE * (any_value(s_all) + 10000)::DOUBLE)
                               / ((sum(s) + 1)::DOUBLE * (any_value(t_all) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM b, (SELECT sum(s) AS s_all, sum(t) AS t_all FROM b) GROUP BY bucket),
sums AS (
  SELECT doc_id, sum(gain * n) AS total
  FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(words) AS x FROM w) GROUP BY doc_id, x)
  JOIN b USING (x) JOIN g USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(floor(total / len(words)), 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM w LEFT JOIN sums USING (doc_id)),
ranked AS (
  SELECT *, weight + noise AS score, n_features >= 20 AS fit,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS nth,
         10 * (count(*) FILTER (n_features >= 20) OVER ()) // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND nth <= drawn THEN nth END AS rank FROM ranked
""".replace("@CRC@", _CRC)

_OP10 = r"""
WITH
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM iw WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n),
hit AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM places) JOIN win USING (n, win)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
n_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n_hit USING (doc_id) LEFT JOIN n_items USING (doc_id)
"""

_OP1 = r"""
WITH
d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id),
raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (
  SELECT doc_id, source, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM raw),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source),
frequent AS (
  SELECT n.source, line FROM norm n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source WHERE line <> ''
  GROUP BY n.source, line, docs HAVING count(DISTINCT doc_id) > 5 AND count(DISTINCT doc_id) > docs * 0.01),
removed AS (
  SELECT doc_id, sum(len(string_split(n.line, ' '))) AS n
  FROM norm n JOIN frequent f ON n.line = f.line AND n.source IS NOT DISTINCT FROM f.source GROUP BY doc_id)
SELECT *, NOT base_failed AND NOT removed_words > n_words * 0.7 AS kept
FROM (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS removed_words,
         len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN removed USING (doc_id))
"""

_OP2 = r"""
WITH RECURSIVE
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
squeezed AS (SELECT doc_id, i, raw, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM raw),
masked AS (SELECT *, regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM squeezed),
norm AS (
  SELECT doc_id, i, raw, CASE WHEN len(string_split(line, ' ')) - (length(line) - length(replace(line, '<*>', ''))) / 3 >= 3 THEN line ELSE plain END AS line
  FROM masked),
l AS (
  SELECT doc_id, i, line, len(string_split(line, ' ')) AS n, array_to_string(string_split(line, ' ')[1:4], ' ') AS lead
  FROM norm WHERE line <> '' AND len(string_split(line, ' ')) >= 5),
k AS (SELECT line, n, lead, count(DISTINCT doc_id) AS docs, min(doc_id) AS carrier FROM l GROUP BY line, n, lead),
rounds AS (
  SELECT *, NULL::VARCHAR AS template FROM k
  UNION ALL
  SELECT line, n, lead, docs, carrier,
         CASE WHEN follows OR line = leader THEN leader WHEN NOT bool_or(follows) OVER (PARTITION BY n, lead) THEN line END
  FROM (
    SELECT *, line <> leader AND len(list_filter(pairs, lambda p: p[1] = p[2])) >= 0.6 * len(pairs) AS follows
    FROM (
      SELECT *, list_filter(list_zip(string_split(line, ' ')[5:], string_split(leader, ' ')[5:]), lambda p: p[1] <> '<*>' OR p[2] <> '<*>') AS pairs
      FROM (
        SELECT *, first_value(line) OVER (PARTITION BY n, lead ORDER BY docs DESC, carrier, line) AS leader
        FROM rounds WHERE template IS NULL)))),
t AS (SELECT line, template FROM rounds WHERE template IS NOT NULL),
lt AS (SELECT doc_id, i, n, template FROM l JOIN t USING (line)),
rec AS (
  SELECT template, min(doc_id) AS first FROM lt GROUP BY template, n
  HAVING count(DISTINCT doc_id) >= CASE WHEN n >= 20 THEN 2 ELSE 3 END),
gone AS (SELECT doc_id, i FROM lt JOIN rec USING (template) WHERE doc_id <> first),
out AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) FILTER (g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_dropped
  FROM raw LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n_dropped > 0 THEN coalesce(out.text, '') ELSE d.text END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       coalesce(n_dropped > 0 AND length(coalesce(out.text, '')) < length(d.text) * (1 - 0.7), false) AS depleted
FROM documents d LEFT JOIN out USING (doc_id)
"""

_OP4 = r"""
WITH
m AS (
  SELECT conv_id, coalesce(role, '') AS speaker, coalesce(text, '') AS text, coalesce(role, '') = 'system' AS system,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS viewer FROM m WHERE NOT system),
p AS (
  SELECT m.conv_id, viewer, place // 64 AS segment, place, speaker = viewer AND NOT system AS own,
         '<|begin|>' || CASE WHEN system THEN 'system' WHEN speaker = viewer THEN 'assistant' ELSE 'user ' || replace(speaker, '<|', '< |') END
           || chr(10) AS head,
         replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM m JOIN v ON m.conv_id IS NOT DISTINCT FROM v.conv_id),
q AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, viewer, segment ORDER BY place) AS stop FROM p)
SELECT conv_id, viewer AS speaker, segment, count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS text,
       coalesce(string_agg((stop - length(body))::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY place) FILTER (own), '') AS mask
FROM q GROUP BY conv_id, viewer, segment
"""

QUERIES = {
    "op2_line_dedup": op2_line_dedup,
    "op1_quality_rules": op1_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_chat_perspectives": op4_chat_perspectives,
    "op5_license_scans": op5_license_scans,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_secret_scans": op7_secret_scans,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_pii": op9_pii,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_neighbours": op12_quality_neighbours,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE = {
    "op4_chat_perspectives": _OP4,
    "op2_line_dedup": _OP2,
    "op1_quality_rules": _OP1,
    "op10_benchmark_decontamination": _OP10,
    "op11_merkle_manifest": _OP11,
    "op13_importance_resampling": _OP13,
}
