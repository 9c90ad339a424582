"""The training-data operators applied to the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import chat, decontaminate, langid, licenses, lm, merkle, neardup, packing, sharding, simhash, substring, warc, whitening
from hirelake.session import Scratch, shared_path, stored

VOCABULARY = "byte_bpe_50k.json"

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    """Place of a public tokenizer's file, installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(sql: str | None = None):
    def register(function):
        LLM_QUERIES[function.__name__] = function
        if sql:
            LLM_ORACLE[function.__name__] = sql
        return function

    return register


@_query("""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), firsts AS (
  SELECT k, min(doc_id) AS least FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT windows.doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (k) WHERE doc_id > least)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS t
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "substring")
    kept = substring.keep_first_passages(_table(spark, sf_dir, "documents"), scratch, ["doc_id"])
    result = stored(kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")),
                    "substring-result")
    scratch.drop()
    return result


@_query()
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "neardup")
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), scratch)
    result = stored(found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                 F.col("component").alias("component_id")), "neardup-result")
    scratch.drop()
    return result


@_query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    learnable = docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull())
    return langid.predict(docs, langid.fit(learnable), ["doc_id", "held_out"])


@_query("""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), h AS (
  SELECT *, sha1(body) AS hex FROM p
), n AS (
  SELECT *, list_transform(range(8), lambda i: list_reduce(
    list_transform(range(5), lambda j: instr('0123456789abcdef', substr(hex, (5 * i + j + 1)::BIGINT, 1)) - 1),
    lambda a, b: 16 * a + b)) AS parts FROM h
)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string(list_transform(parts, lambda x: array_to_string(list_transform([32768, 1024, 32, 1],
    lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x // d) % 32 + 1)::BIGINT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM n
""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, scratch = shared_path(spark, "archives"), Scratch(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path, scratch)
    scratch.drop()
    return warc.read_archives(spark, path).drop("payload", "url")


PROBE = "</s>[INST] ok [/INST]"


@_query(r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) + 21 AS shown FROM rows
), grouped AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(shown)::BIGINT AS formatted_chars
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars
FROM grouped
""")
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr("-1L", "id", "if(id = 0, 'user', 'assistant')", f"'{PROBE}'")
    shown = chat.format_chats(rows.union(probe)).select(
        "conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(chat.masked(F.col("formatted")), chat.unescape), "").alias("loss"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return shown.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@_query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_within``: for every id divisible by 100, how many other documents differ in at most 3 bits; else null."""
    scratch = Scratch(spark, "simhash")
    edits = simhash.edited(_table(spark, sf_dir, "documents"), scratch)
    version = F.explode(F.array(F.struct(F.lit(False).alias("changed"), F.col("text").alias("t"), F.lit("").alias("sha")),
                                F.struct(F.lit(True).alias("changed"), F.col("edited").alias("t"),
                                         F.sha2("edited", 256).alias("sha")))).alias("v")
    both = edits.select("key", "next_key", "id", "copies", "n_chars", version).select(
        "key", "next_key", "id", "copies", "n_chars", "v.changed", "v.sha", "v.t")
    marks = scratch.table(simhash.fingerprints(
        both, ["key", "next_key", "id", "copies", "n_chars", "changed", "sha"], "t"), "marks")
    own = marks.filter(~F.col("changed"))
    after = marks.filter("changed").select("key", F.col("fp").alias("edited_fp"), F.col("sha").alias("edited_sha256"))
    following = own.select(F.col("key").alias("next_key"), F.col("fp").alias("next_fp"))
    rows = own.join(after, "key").join(following, "next_key")
    is_query = F.coalesce(F.col("id") % 100 == 0, F.lit(False))
    sizes = scratch.table(own.groupBy("fp").agg(F.sum("copies").alias("n")), "sizes")
    near = simhash.within_radius(own.filter(is_query).select("fp"), sizes).groupBy("query").agg(F.sum("n").alias("n"))
    near = scratch.table(near.select(F.col("query").alias("fp"), (F.col("n") - 1).alias("n_within")), "near")
    rows = rows.filter(~is_query).withColumn("n_within", F.lit(None).cast("long")).unionByName(
        rows.filter(is_query).join(near, "fp"))
    hexed = {n: F.lower(F.lpad(F.hex(c), 16, "0")) for n, c in {"fingerprint": "fp", "edited_fingerprint": "edited_fp"}.items()}
    result = stored(rows.withColumns(hexed).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        simhash.likeness("fp", "edited_fp").alias("near_edited"), simhash.likeness("fp", "next_fp").alias("near_next"),
        "n_within", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy"),
        "simhash-result")
    scratch.drop()
    return result


@_query()
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(_table(spark, sf_dir, "documents"))
    starts, base, own = F.col("base.start"), F.col("base.label"), F.col("detections.label")
    best = F.coalesce(F.array_max("detections.confidence"), F.lit(0.0))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, licenses.BASE_CONFIDENCE).otherwise(0.0)).alias("score"))


@_query(r"""
WITH items AS (
  SELECT item_id::VARCHAR AS name, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), keys AS (
  SELECT DISTINCT name, n, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT name, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p
        FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM keys))
), hits AS (
  SELECT doc_id, p, n, name FROM places JOIN keys USING (n, k)
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS list
  FROM (SELECT DISTINCT doc_id, name FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "decontaminate")
    found = decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), scratch)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", decontaminate.covered().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


@_query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    pieces = packing.pack(_table(spark, sf_dir, "documents"), scratch, vocabulary())
    result = stored(pieces.withColumnRenamed("id", "doc_id").drop("ids"), "packing-result")
    scratch.drop()
    return result


@_query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "sharding")
    placed = sharding.shard(_table(spark, sf_dir, "documents"), scratch)
    result = stored(placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard")), "sharding-result")
    scratch.drop()
    return result


@_query(r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, text,
    sha256(concat(coalesce(concat(octet_length(encode(doc_id::VARCHAR)), ':', doc_id), '-'),
      coalesce(concat(octet_length(encode(source)), ':', source), '-'),
      coalesce(concat(octet_length(encode(lang)), ':', lang), '-'),
      coalesce(concat(octet_length(encode(n_chars::VARCHAR)), ':', n_chars), '-'),
      coalesce(concat(octet_length(encode(text)), ':', text), '-'))) AS leaf,
    sha256(concat(coalesce(concat(octet_length(encode(doc_id::VARCHAR)), ':', doc_id), '-'),
      coalesce(concat(octet_length(encode(source)), ':', source), '-'),
      coalesce(concat(octet_length(encode(lang)), ':', lang), '-'),
      coalesce(concat(octet_length(encode(n_chars::VARCHAR)), ':', n_chars), '-'),
      coalesce(concat(octet_length(encode(replace(text, chr(10), ''))), ':', replace(text, chr(10), '')), '-'))) AS cut,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) AS crc
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows
), lower AS (
  SELECT source, 0 AS level, place AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
  FROM lower WHERE n > 1 GROUP BY source, level, i // 3
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM lower WHERE n = 1
), upper AS (
  SELECT 0 AS level, s AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
  FROM upper WHERE n > 1 GROUP BY level, i // 3
), lower_sides AS (
  SELECT x.source, x.level, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l,
    coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM lower x JOIN lower y ON x.source IS NOT DISTINCT FROM y.source AND x.level = y.level AND x.i // 3 = y.i // 3
  WHERE x.n > 1 GROUP BY ALL
), upper_sides AS (
  SELECT x.level, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l,
    coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM upper x JOIN upper y ON x.level = y.level AND x.i // 3 = y.i // 3
  WHERE x.n > 1 GROUP BY ALL
), ways AS (
  SELECT leaves.source, place, 0 AS part, level, l, r FROM leaves JOIN lower_sides d
    ON leaves.source IS NOT DISTINCT FROM d.source AND d.i = place // (3 ** level)::BIGINT
  UNION ALL
  SELECT leaves.source, place, 1, level, l, r FROM leaves JOIN subroots
    ON leaves.source IS NOT DISTINCT FROM subroots.source JOIN upper_sides d ON d.i = s // (3 ** level)::BIGINT
), proofs AS (
  SELECT source, place, list({'l': l, 'r': r, 'a': ''} ORDER BY part, level) AS p FROM ways GROUP BY source, place
), told AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, coalesce(p, []) AS p,
    CASE WHEN crc % 2 = 0 THEN cut ELSE leaf END AS start
  FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source
    LEFT JOIN proofs ON leaves.source IS NOT DISTINCT FROM proofs.source AND leaves.place = proofs.place
), folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x.l || x.r), '')) AS proof_sha256,
    list_reduce(list_concat([{'l': '', 'r': '', 'a': start}], p),
      lambda x, y: {'l': '', 'r': '', 'a': sha256(y.l || x.a || y.r)}).a AS folded_root
  FROM told
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
""")
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "merkle")
    docs = _table(spark, sf_dir, "documents")
    text = F.col("text")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & text.contains("\n")
    cut = merkle.leaf([*rest, F.replace(text, F.lit("\n"), F.lit(""))])
    leaves = docs.select("doc_id", "source", merkle.leaf([*rest, text]).alias("leaf"),
                         F.when(chosen, F.unhex(cut)).alias("tampered"))
    found = merkle.manifest(leaves, scratch, ["doc_id", "tampered"])
    start = F.coalesce(F.lower(F.hex("kept.tampered")), "leaf")
    folded = found.select("kept.doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256)
                          .alias("proof_sha256"), merkle.fold(start, F.col("proof")).alias("folded_root"))
    result = stored(folded.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-result")
    scratch.drop()
    return result


@_query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    found = whitening.whiten(rows, model, ["vec_id"])
    return found.select(
        "vec_id", "component", F.lit(model.n if model else None).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"))


@_query()
def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is neither learnt from nor held out."""
    scratch = Scratch(spark, "lm")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    docs = _table(spark, sf_dir, "documents").withColumns({"held_out": F.coalesce(held, F.lit(False)), "learn": ~held})
    found, model = lm.score(docs, scratch, ["doc_id", "held_out"], "learn")
    result = stored(found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long")
                                 .alias("train_tokens"), "base_score", "score"), "lm-result")
    scratch.drop()
    return result
