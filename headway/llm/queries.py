"""Queries of the corpus operators over the driver tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import decontam, licenses, manifest, minhash, mixing, ogg, packing, pages, secrets, sharding, spelling, tokens, toxicity
from headway.llm.common import table

#: Bytes of text that a shard may hold.
SHARD_BYTES = 1 << 20


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.describe_ogg(ogg.store_ogg(table(spark, sf_dir, "documents")))


def op5_site_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_findings(spark), secrets.dictionary(docs)))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0].drop("begun")


def op11_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def merkle_rows(docs: DataFrame) -> DataFrame:
    """The digests of each row's proof, and whether a version whose capitals are lowered would pass."""
    fields = [F.col(n) for n in ("doc_id", "source", "lang", "n_chars")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, manifest.leaf(*fields, F.translate("text", upper, upper.lower())))
    rows = manifest.manifest(docs, manifest.leaf(*fields, F.col("text")), also={"changed": tampered})
    again = rows.withColumn("folded_root", manifest.folded(F.coalesce("row.changed", "leaf"), F.col("proof")))
    proof = F.sha2(manifest.siblings(F.col("proof")).cast("binary"), 256)
    return again.select(F.col("row.id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_extendible_sharding": op1_extendible_sharding,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_spaced_seed_decontamination": op3_spaced_seed_decontamination,
    "op4_ogg_media": op4_ogg_media,
    "op5_site_style_tree_text": op5_site_style_tree_text,
    "op6_secret_scan": op6_secret_scan,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_source_mixing": op10_source_mixing,
    "op11_cost_balanced_packing": op11_cost_balanced_packing,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
}

def _places(mask: str) -> str:
    return "[" + ", ".join(str(i + 1) for i, c in enumerate(mask) if c == "1") + "]"


#: Position-wise comparison of words, with a join on the concatenated words under each mask; every window of the item
#: that holds a hit is looked at.
_SPAN = max(map(len, decontam.MASKS))
_LEAKS = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS MATERIALIZED (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM benchmark),
masks AS (
  SELECT {_SPAN} AS least, unnest([{", ".join(map(_places, decontam.MASKS))}]) AS places, unnest([{", ".join(str(len(m)) for m in decontam.MASKS)}]) AS size
  UNION ALL SELECT DISTINCT 0, range(1, len(w) + 1), len(w) FROM b WHERE len(w) BETWEEN 1 AND {_SPAN} - 1),
bs AS (
  SELECT item_id, p, least, size, list_transform(places, lambda o: w[p + o]) AS k
  FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS p FROM b, masks WHERE CASE WHEN least = 0 THEN len(w) = size ELSE len(w) >= least END)),
ds AS (SELECT doc_id, p, least, size, list_transform(places, lambda o: w[p + o]) AS k FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS p FROM d, masks WHERE len(w) >= size)),
hit AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS shift, bs.p AS ip FROM ds JOIN bs USING (least, size, k)),
wide AS (SELECT doc_id, item_id, shift, least(len(b.w), 24) AS n, ip, len(b.w) AS total FROM hit JOIN b USING (item_id)),
side AS (SELECT DISTINCT doc_id, item_id, shift, n, unnest(range(greatest(ip - n + 1, 0), least(ip, total - n) + 1)) AS first FROM wide),
cmp AS (
  SELECT doc_id, item_id, n, shift + first AS doc_word, len(list_filter(range(0, n), lambda i: shift + first + i >= 0 AND d.w[shift + first + i + 1] = b.w[first + i + 1])) AS matched
  FROM side JOIN d USING (doc_id) JOIN b USING (item_id))
SELECT doc_id, item_id, matched::BIGINT AS matched, n::BIGINT AS compared, doc_word::BIGINT AS doc_word
FROM cmp WHERE matched >= 0.75 * n AND (n >= {_SPAN} OR matched = n)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, n DESC, doc_word) = 1
"""

def _manifest_sql(depth: int = 5) -> str:
    """Trees of up to 16 ** ``depth`` rows a source and as many sources, a level after the other; crc32 is computed bit by bit."""

    def levels(name: str, group: str) -> list[str]:
        # {name}0: nodes (group, pos, n, h); {name}r1 ..: the runs of 16 of each level (group, run, n, s)
        out = []
        for k in range(depth):
            out.append(f"{name}r{k} AS (SELECT {group}, pos // 16 AS run, n, string_agg(h, '' ORDER BY {name}{k}.pos) AS s FROM {name}{k} GROUP BY {group}, pos // 16, n)")
            out.append(f"{name}{k + 1} AS (SELECT {group}, run AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS h FROM {name}r{k})")
        return out

    def way(name: str, group: str, base: str, kept: str) -> list[str]:
        # {name}w{k}: the folded node, given and claimed, and the siblings so far
        out = [f"{name}w0 AS ({base})"]
        for k in range(depth):
            at = f"(w.pos // {16**k} % 16 * 64)::INT"
            fold = lambda c: f"CASE WHEN r.n > 1 THEN sha256(left(r.s, {at}) || {c} || substr(r.s, {at} + 65)) ELSE {c} END AS {c}"  # noqa: B023, E731
            out.append(f"{name}w{k + 1} AS (SELECT w.{group}, w.pos, {kept}, {fold('claimed')}, sib || CASE WHEN r.n > 1 THEN left(r.s, {at}) || substr(r.s, {at} + 65) ELSE '' END AS sib FROM {name}w{k} w JOIN {name}r{k} r ON r.{group} = w.{group} AND r.run = w.pos // {16 ** (k + 1)})")
        return out

    told = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(map(told, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    parts = [
        "t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS bits)",
        "c AS (SELECT d.*, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, bits[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM documents d, t)",
        f"leaves AS (SELECT doc_id, coalesce('s' || source, '') AS src, {digest('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM c)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n FROM leaves)",
        "a0 AS (SELECT src, pos, n, leaf AS h FROM ranked)",
        *levels("a", "src"),
        f"sub AS (SELECT 0 AS every, src, h AS subroot, row_number() OVER (ORDER BY encode(src)) - 1 AS pos, count(*) OVER () AS n FROM a{depth})",
        "b0 AS (SELECT every, pos, n, subroot AS h FROM sub)",
        *levels("b", "every"),
        *way("a", "src", "SELECT src, pos, doc_id, leaf, coalesce(changed, leaf) AS claimed, '' AS sib FROM ranked", "doc_id, leaf"),
        *way("b", "every", f"SELECT every, sub.pos, doc_id, leaf, subroot, claimed, sib FROM aw{depth} JOIN sub USING (src)", "doc_id, leaf, subroot"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, claimed AS folded_root, claimed = h AS verified FROM bw{depth} CROSS JOIN (SELECT h FROM b{depth})"


ORACLES = {
    "op12_merkle_manifest": _manifest_sql(),
    "op3_spaced_seed_decontamination": _LEAKS,
    "op1_extendible_sharding": f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS b
  FROM documents),
sums AS (
  SELECT k.depth, left(b, k.depth::INT) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
  FROM d, (SELECT unnest(range(0, 61)) AS depth) k GROUP BY 1, 2),
fits AS (SELECT * FROM sums WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1 OR depth = 60)
SELECT d.doc_id, d.n_bytes, f.shard, f.depth::BIGINT AS depth, f.shard_bytes, f.shard_docs
FROM d JOIN fits f ON f.shard = left(d.b, f.depth::INT)
QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY f.depth) = 1
""",
}
