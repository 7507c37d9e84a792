"""Queries that apply the operators to their whole tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, langid, manifest, packing, prefixtrie, quality, repeats, secrets, sharding, simhash, topk
from .clusterio import cut, table


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality.remainder(F.col("doc_id"), 3) == 1
    model = quality.train(docs, labels.where(~held_out))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_benchmark_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("bm_words").alias("n_words"),
        F.col("bm_hit").alias("n_hit"),
        F.size("bm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bm_items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
        F.col("bm_longest").alias("longest_match"),
    )


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    nodes, leaves = chat.format_chats(rows.unionByName(probe))
    return chat.digests(chat.read_back(nodes, leaves))


def op5_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(secrets.listed(secrets.strong_only(F.col("_spans"))), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base, secrets.listed(F.col("_spans")).alias("spans"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = divergence.judge(docs, divergence.references(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op7_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = quality.remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_interval_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = repeats.strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), sharding.uniform_tree(40))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.when(quality.remainder(F.col("doc_id"), 5) == 0, F.translate("text", manifest.UPPER, manifest.LOWER))
    out = manifest.manifest(docs, tampered=lowered)
    folded = manifest.fold(F.col("shown"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", manifest.proof_of(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_exhaustive_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)


def op13_radix_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = cut(prefixtrie.turns_in_order(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    c = F.col("conv_id")
    rebuilt = prefixtrie.with_heads(convs, c - c % 100, quality.remainder(c, 6).cast("int"), 5)
    return prefixtrie.prefix_nodes(prefixtrie.keyed(rebuilt))


QUERIES = (
    op1_bradley_terry_quality,
    op2_benchmark_suffix_match,
    op3_simhash_components,
    op4_prefix_tree_chat,
    op5_credential_linking,
    op6_divergence_rules,
    op7_naive_bayes_language,
    op8_interval_tree_repeats,
    op9_weighted_hash_tree,
    op10_length_bucket_packing,
    op11_merkle_witnesses,
    op12_exhaustive_top_k,
    op13_radix_prefix_trie,
)


def queries() -> dict:
    import corpus_pipeline

    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


_CONTAMINATION = r"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
place AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM doc, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hit AS (SELECT r, i, p.n, item_id FROM place p JOIN win USING (n, s)),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(k) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM hit GROUP BY r),
joined AS (SELECT r, i - row_number() OVER (PARTITION BY r, t.item_id, d ORDER BY i) AS g, r AS rr, item_id, d, i, n FROM (SELECT DISTINCT h.r, h.item_id, h.i, h.n, h.i - x.j AS d FROM hit h JOIN (SELECT item_id, least(len(w), 13) AS n, j, array_to_string(w[j:j + least(len(w), 13) - 1], ' ') AS s FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(j) WHERE len(w) > 0) x ON x.item_id = h.item_id AND x.n = h.n JOIN place p ON p.r = h.r AND p.i = h.i AND p.n = h.n AND p.s = x.s) t),
longest AS (SELECT r, max(m) AS m FROM (SELECT r, count(*) + max(n) - 1 AS m FROM joined GROUP BY r, item_id, d, g) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(m, 0) AS BIGINT) AS longest_match
FROM doc LEFT JOIN word USING (r) LEFT JOIN found USING (r) LEFT JOIN longest USING (r)
"""

_CHATS = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role || chr(1) || text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) + length(role) - length(replace(role, chr(10), '')) + 17 AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _secrets_sql() -> str:
    """The scan in SQL: the same split-and-sum of lengths for positions, and the links by a self-join of spans."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    tests = {"assign": f"length(regexp_extract(m, {quote(secrets.ASSIGN)}, 2)) >= 6", "user": f"length(regexp_extract(m, {quote(secrets.USER)}, 2)) >= 3", "opaque": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')", "address": "length(m) >= 10"}
    each = " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{kind}' AS kind, '{role}' AS role, {strong} AS strong, i, length(parts[i]) AS gap, length(ms[i]) AS len, {tests.get(kind, 'TRUE').replace('(m,', '(ms[i],').replace('length(m)', 'length(ms[i])')} AS ok "
        f"FROM (SELECT r, string_split_regex(t, {quote(pattern)}) AS parts, regexp_extract_all(t, {quote(pattern)}) AS ms FROM doc), unnest(range(1, len(ms) + 1)) AS u(i)"
        for k, (kind, role, strong, pattern, _) in enumerate(secrets.KINDS)
    )
    near = lambda role: f"EXISTS (SELECT 1 FROM span o WHERE o.r = s.r AND o.role = '{role}' AND (o.k, o.s, o.e) <> (s.k, s.s, s.e) AND ((o.s, o.e, o.k) < (s.s, s.e, s.k) AND s.s - o.e <= 200 OR (o.s, o.e, o.k) > (s.s, s.e, s.k) AND o.s - s.e <= 200))"
    over = "EXISTS (SELECT 1 FROM span o WHERE o.r = s.r AND o.strong AND ((o.s, o.e, o.k) < (s.s, s.e, s.k) AND o.e > s.s OR (o.s, o.e, o.k) > (s.s, s.e, s.k) AND o.s < s.e))"
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
piece AS ({each}),
span AS (SELECT r, k, kind, role, strong, u - len AS s, u AS e FROM (SELECT *, CAST(sum(gap + len) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS u FROM piece) WHERE ok),
kept AS (SELECT * FROM span s WHERE strong OR (NOT {over} AND CASE role WHEN 'identifier' THEN {near("secret")} WHEN 'secret' THEN {near("identifier")} OR {near("endpoint")} ELSE {near("identifier")} AND {near("secret")} END)),
lists AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, {listed} FILTER (strong) AS base, {listed} AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM doc LEFT JOIN lists USING (r)
"""


def _crc32(x: str) -> str:
    """The unsigned CRC-32 of a number's decimal text, bit by bit."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: ord(c)::BIGINT)), lambda crc, b: "
        "list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, y: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
    )


def _manifest_sql(levels: int = 5, above: int = 3) -> str:
    """Trees of at most 16 ** ``levels`` leaves a source and 16 ** ``above`` sources, level by level."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    told = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(told(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    run = "(PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN {} AND {})"

    def tree(name: str, base: str, n: int) -> str:
        out = [f"{name}0 AS ({base})"]
        for k in range(n):
            steps = ", ".join(f"coalesce(string_agg(digest, '') OVER {run.format(a, b)}, '') AS {side}" for side, a, b in (("l", "UNBOUNDED PRECEDING", "1 PRECEDING"), ("r", "1 FOLLOWING", "UNBOUNDED FOLLOWING")))
            out.append(f"{name}s{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, {steps} FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT g, pos // 16 AS pos, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}s{k} GROUP BY g, pos // 16)")
        return ",\n".join(out)

    def up(first: str, last: str, name: str, n: int, pos: str, keep: str) -> str:
        out = []
        for k in range(n):
            step = f"SELECT p.* REPLACE (p.proof || s.l || s.r AS proof, CASE WHEN s.n = 1 THEN p.folded ELSE sha256(s.l || p.folded || s.r) END AS folded) FROM {first if not k else f'{last}{k - 1}'} p JOIN {name}s{k} s ON s.g = p.{keep} AND s.pos = p.{pos} // {16**k}"
            out.append(f"{last}{k} AS ({step})")
        return ",\n".join(out)

    return f"""
WITH doc AS (SELECT *, coalesce('s' || source, '') AS g, {leaf("text")} AS leaf, CASE WHEN text IS NOT NULL AND {_crc32("doc_id")} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS shown FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM doc),
{tree("a", "SELECT g, pos, leaf AS digest FROM placed", levels)},
sub AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS gpos, digest AS subroot FROM a{levels}),
{tree("b", "SELECT '' AS g, gpos AS pos, subroot AS digest FROM sub", above)},
way AS (SELECT doc_id, leaf, pos, p.g, '' AS top, gpos, subroot, '' AS proof, shown AS folded FROM placed p JOIN sub USING (g)),
{up("way", "w", "a", levels, "pos", "g")},
{up(f"w{levels - 1}", "v", "b", above, "gpos", "top")}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM v{above - 1}, b{above}
"""


_TOP_K = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM pairs QUALIFY rank <= 10
"""

_TRIE = f"""
WITH own AS (SELECT conv_id, list({{'i': sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'n': length(coalesce(text, ''))}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
asked AS (SELECT conv_id, ts, {_crc32("conv_id")} % 6 AS h FROM own),
again AS (SELECT a.conv_id, list_concat(coalesce(o.ts[1:h], []), a.ts[h + 1:]) AS ts FROM asked a LEFT JOIN own o ON o.conv_id = a.conv_id - a.conv_id % 100),
starts AS (SELECT conv_id, d, list_transform(ts[1:d], lambda t: t.i) AS p, CASE WHEN d > 0 THEN ts[d].n ELSE 0 END AS chars, len(ts) = d AS done FROM again, unnest(range(0, len(ts) + 1)) AS u(d)),
node AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(chars) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (done), '')) AS e FROM starts GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
told AS (SELECT n.*, coalesce(k, 0) AS k FROM node n LEFT JOIN kids USING (d, p)),
below AS (SELECT a.d, a.p, count(*) FILTER (b.k = 0) AS leaves, CAST(sum(b.saved) AS BIGINT) AS saved FROM told a JOIN told b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.d, a.p)
SELECT t.conv_id, t.d AS depth, u.conv_id AS parent_conv_id, t.n AS n_convs, t.k AS n_children, leaves AS n_leaves, below.saved AS saved_tokens, t.e AS ends_sha256
FROM told t JOIN below USING (d, p) LEFT JOIN told u ON u.d = t.d - 1 AND u.p = t.p[1:t.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say what a query returns: not for trained models, XXH64 and other hashes, or optimal bucket bounds."""
    return {"op2_benchmark_suffix_match": _CONTAMINATION, "op4_prefix_tree_chat": _CHATS, "op5_credential_linking": _secrets_sql(), "op11_merkle_witnesses": _manifest_sql(), "op12_exhaustive_top_k": _TOP_K, "op13_radix_prefix_trie": _TRIE}
