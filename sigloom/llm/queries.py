"""The thin contract queries opN_<name> and their SQL, each over the whole of its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment as _alignment
from . import chat as _chat
from . import decontaminate as _decontaminate
from . import embeddings as _embeddings
from . import language as _language
from . import licenses as _licenses
from . import merkle as _merkle
from . import minhash as _minhash
from . import packing as _packing
from . import pieces as _pieces
from . import tokenbin as _tokenbin
from . import toxicity as _toxicity
from . import warc as _warc
from .common import cut, shared_root, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: the words of the contracts, in RE2 and Java syntax alike.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _decontaminate.find_matches(docs, table(spark, sf_dir, "benchmark"), name="found")
    items = F.array_distinct(F.transform("found.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, s, grams.n, item_id FROM grams JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT vec_id, e, n FROM u WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a) USING (vec_id)"""


def held_out_of(parts: int, which: int):
    """Whether crc32 of the id as text leaves the remainder of the held-out rows."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == which


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = _language.fit(_language.sample(docs.filter(~held_out_of(4, 2))))
    found = _language.predict(docs.select("doc_id", "text"), model, name="language")
    return found.select("doc_id", F.coalesce(held_out_of(4, 2), F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    added = F.transform("blocks", lambda b: b["label"])
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["held"] / b["of"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, added)))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def _op3_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    all_t = _licenses.templates()
    phrases = " UNION ALL ".join(f"SELECT r, '{t.label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda s: " + " AND ".join(f"w[s + {k}] = '{x}'" for k, x in enumerate(t.words)) + ")) - 1 AS start FROM d" for t in all_t if t.phrase)
    notices = " UNION ALL ".join(
        f"SELECT r, '{t.label}' AS label, list_max(list_transform(range(1, len(w) + 1), lambda s: len(list_intersect(w[s:s + {t.size - 1}], {quoted(t.tokens)})))) / {len(t.tokens)}.0 AS share, {t.need} / {len(t.tokens)}.0 AS least FROM d WHERE len(list_intersect(w, {quoted(t.tokens)})) >= {t.need}"
        for t in all_t if not t.phrase
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS ({phrases}),
n AS (SELECT r, label, share FROM ({notices}) WHERE share >= least - 1e-12),
ps AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY r),
ls AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT r, label, 1.0 AS share FROM p UNION ALL SELECT r, label, share FROM n) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN ps USING (r) LEFT JOIN ls USING (r)"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return _warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000"""


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = _toxicity.fit(_toxicity.sample(docs, labels.filter(~held_out_of(5, 0))))
    found = _toxicity.score(docs, model, name="score")
    return found.select("doc_id", F.coalesce(held_out_of(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _pieces.stored(docs, public_tokenizers.path("piece_bpe_32k.model"), f"{shared_root(spark)}/pieces-{uuid.uuid4().hex}")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _tokenbin.read_shards(_tokenbin.write_shards(docs, public_tokenizers.path("word_bpe_49k.json")))


#: Fixed value: the conversation that the contract adds.
ADDED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id bigint, turn bigint, role string, text string")
    written = cut(_chat.format_chats(rows.unionByName(added)))
    return _chat.read_back(written)


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM c),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + len(regexp_extract_all(text, '#+ ').list_filter(lambda x: length(x) >= 4)) AS n FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + 4 + length(role) + 2 + 7 + 1) AS BIGINT) AS formatted_chars,
       bool_and(coalesce((prev IS NULL AND role IN ('system', 'user')) OR (prev IN ('system', 'assistant') AND role = 'user') OR (prev = 'user' AND role = 'assistant'), false)) AND max_by(role, p) = 'assistant' AS valid
FROM e GROUP BY conv_id"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.coalesce(held_out_of(7, 0), F.lit(False)), F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))
    made = _merkle.manifest(docs, columns=["doc_id", "source", "lang", "n_chars", "text"], id="doc_id", group="lang", found={"n_chars": tampered})
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"), "folded_root", "verified")


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"


#: crc32 of an id as text: bits by the reversed polynomial, byte by byte.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, list_reduce([xor(c & 255, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))), 4294967295)"

OP12_SQL = f"""
WITH RECURSIVE f AS (SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
                            {_field("doc_id")} || {_field("source")} || {_field("lang")} AS head, {_field("text")} AS tail, n_chars, coalesce({_CRC} % 7 = 0, false) AS hit FROM documents),
l AS (SELECT r, doc_id, g, sha256(head || {_field("n_chars")} || tail) AS leaf, sha256(head || {_field("(n_chars + CASE WHEN hit THEN 1 ELSE 0 END)")} || tail) AS seen FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t(g, lvl, i, h) AS (SELECT g, 0, i, leaf FROM o
                    UNION ALL SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM t) WHERE n > 1 GROUP BY g, lvl, i // 2),
m AS (SELECT g, max(lvl) AS lvl FROM t GROUP BY g),
s AS (SELECT g, h FROM t JOIN m USING (g, lvl)),
u(lvl, i, h) AS (SELECT 0, g, h FROM s
                 UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY lvl, i // 2),
n AS (SELECT g, lvl, i, h, false AS top FROM t UNION ALL SELECT 0, lvl, i, h, true FROM u),
e AS (SELECT max(lvl) AS lvl, max_by(h, lvl) AS root FROM u),
p(r, g, lvl, i, top, proof, h) AS (
    SELECT r, g, 0, i, false, '', seen FROM o
    UNION ALL
    SELECT p.r, p.g, CASE WHEN up THEN 0 ELSE p.lvl + 1 END, CASE WHEN up THEN p.g ELSE p.i // 2 END, p.top OR up, CASE WHEN up THEN p.proof ELSE p.proof || coalesce(n.h, '') END,
           CASE WHEN up THEN p.h WHEN n.h IS NULL THEN sha256(p.h) WHEN p.i % 2 = 0 THEN sha256(p.h || n.h) ELSE sha256(n.h || p.h) END
    FROM (SELECT p.*, NOT p.top AND p.lvl = m.lvl AS up FROM p JOIN m USING (g), e WHERE NOT (p.top AND p.lvl = e.lvl)) p
    LEFT JOIN n ON n.top = p.top AND n.lvl = p.lvl AND n.i = xor(p.i, 1) AND (p.top OR n.g = p.g) AND NOT up)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, p.h AS folded_root, p.h = root AS verified
FROM o JOIN s USING (g) JOIN p USING (r), e WHERE p.top AND p.lvl = e.lvl"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = _packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_embeddings": op1_embeddings, "op2_language": op2_language, "op4_decontaminate": op4_decontaminate, "op3_licenses": op3_licenses, "op5_warc": op5_warc, "op6_minhash": op6_minhash, "op7_toxicity": op7_toxicity, "op8_pieces": op8_pieces, "op9_token_ids": op9_token_ids, "op10_chat": op10_chat, "op11_alignment": op11_alignment, "op12_merkle": op12_merkle, "op13_packing": op13_packing}


def oracle_sql() -> dict[str, str]:
    return {"op1_embeddings": OP1_SQL, "op3_licenses": _op3_sql(), "op4_decontaminate": OP4_SQL, "op5_warc": OP5_SQL, "op10_chat": OP10_SQL, "op12_merkle": OP12_SQL}
