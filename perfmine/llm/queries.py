"""Queries of this package: one per operator, with its SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfmine.llm import decontamination, language, licenses, neardup, packing, periodic, phrases, pii, secrets, sharding, suffixes, tokens, topk
from perfmine.llm.common import table

ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where the driver's tokenizer files are; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def joined(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_detections(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    doubt = F.aggregate("detections", F.lit(1.0), lambda a, d: a * (1 - d["confidence"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda d: d["label"])).alias("base_labels"),
        joined(F.transform("detections", lambda d: d["label"])).alias("labels"),
        F.round(1 - doubt, 6).alias("score"),
    )


def span_digest(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    """Counts of the base spans by kind, the hash of their places, and all places."""
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter(spans, lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(F.array_join(F.transform(base, place), ","), 256)
    return [*map(count, kinds), digest.alias("base_sha256"), F.array_join(F.transform(spans, place), ",").alias("spans")]


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *span_digest(F.col("spans"), secrets.BASE_KINDS))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


# five-word shingles hold four blanks and shorter sequences fewer, so the two never meet
ORACLES["op3_minhash_dedup"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents
), s as (
  select distinct doc_id, array_to_string(list_slice(words, i, i + 4), ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), links as (
  select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by all) p
  join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * common >= 75 * (na.n + nb.n - common)
), reached as (
  select doc_id as id, doc_id as other from documents
  union select r.id, l.b from reached r join links l on l.a = r.other
)
select r.id as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.other) as component_id, r.id = min(r.other) as kept
from reached r left join n on n.doc_id = r.id group by r.id
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    answers = language.predict_languages(docs, language.trained_on_rest(docs))
    return answers.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op5_exact_topk"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 5
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), ["doc_id"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *span_digest(F.col("spans"), pii.KINDS))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    rounded = {c: F.round(c, 6) for c in ("score", "item_overlap", "question_overlap", "answer_overlap")}
    return found.withColumns(rounded)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_phrases"] = r"""
with d as (
  select row_number() over () as doc, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), p as (
  select doc, lang, generate_subscripts(pieces, 1) as piece, unnest(pieces) as text
  from (select doc, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') as pieces from d)
), w as (
  select doc, lang, piece, generate_subscripts(words, 1) as pos, unnest(words) as w1
  from (select doc, lang, piece, regexp_extract_all(text, '[^\x20\x09]+') as words from p)
), s as (
  select lang, w1, lead(w1) over o as w2, lead(w1, 2) over o as w3 from w window o as (partition by doc, piece order by pos)
), totals as (
  select lang, count(*) as n from w group by lang
), f as (
  select lang, w1 as phrase, 1 as size, count(*) as f from s group by all
  union all select lang, w1 || ' ' || w2, 2, count(*) from s where w2 is not null group by all having count(*) >= 10
  union all select lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) from s where w3 is not null group by all having count(*) >= 10
), cuts as (
  select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r,
    (1000000 * c.f::hugeint * c.f::hugeint) // (l.f::hugeint * r.f::hugeint) as score
  from f c cross join (values (1), (2)) v(k)
  join f l on l.lang = c.lang and l.phrase = array_to_string(list_slice(string_split(c.phrase, ' '), 1, k), ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(list_slice(string_split(c.phrase, ' '), k + 1, 3), ' ')
  where c.size >= 2 and k < c.size
), lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
  select lang, array_to_string(list_slice(string_split(phrase, ' '), i, i + 1), ' ') as phrase, max(f) as longer
  from f cross join (values (1), (2)) v(i) where size = 3 group by all
), kept as (
  select c.*, row_number() over (partition by c.lang order by score desc, a desc, c.phrase) as rank
  from lowest c left join inside i on i.lang = c.lang and i.phrase = c.phrase
  where i.longer is null or 100 * i.longer < 50 * c.a
)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
  cast(n as bigint) as n, cast(score as bigint) as score
from kept join totals using (lang) where rank <= 2000
"""


def repeat_from_a_place(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of one document in ten, words from some place on become a period of that place's first ones."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeat_from_a_place)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    start, length, period = -longest["col2"], longest["length"], -longest["col3"]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_minhash_dedup, op4_language_id, op5_exact_topk, op6_sharding, op7_token_counts, op8_pii, op9_packing, op10_decontamination, op11_phrases, op12_periodic_runs, op13_suffix_dedup)
}
