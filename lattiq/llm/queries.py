"""The queries ``opN_<name>`` of this subpackage and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import bpe, fingerprint, html, jaccard, licences, neighbours, packing, quality, toxicity, urls
from lattiq.llm.common import remainder, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text as digests."""
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, pattern())
    done = bpe.decode(coded, path, pattern())
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def judged(scored: DataFrame, fold: int, out: int) -> DataFrame:
    return scored.select("doc_id", (remainder("doc_id", fold) == out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they and the next document's are."""
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


#: Host, path and verdict of the rules that the query judges by.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that fits every page's url and its verdict."""
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as rules(host, path, verdict)")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


OP4_SQL = """
with split as (
    select page_id,
        translate(regexp_extract(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end, '^([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end, '^[^/?#]*([^?#]*)', 1) as path
    from pages),
rules(r_host, r_path, r_verdict) as (values %s),
fitting as (
    select split.page_id, max_by(struct_pack(rule := r_host || r_path, verdict := r_verdict), length(r_host || r_path)) as best
    from split join rules on (host = r_host or suffix(host, '.' || r_host)) and starts_with(path, r_path)
    group by split.page_id)
select split.page_id, coalesce(host, '') as host, coalesce(path, '') as path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict
from split left join fitting on split.page_id = fitting.page_id
""" % ", ".join(map(str, URL_RULES))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices of every document: the best match, the number of matching lines and the names found."""
    return licences.summary(licences.scan(table(spark, sf_dir, "documents")))


OP5_SQL = """
with templates(name, wording) as (values %s),
normal as (
    select name, list_filter(string_split(regexp_replace(lower(wording), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') as w from templates),
known as (select name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from normal),
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
split as (
    select doc_id, list_filter(string_split(regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') as w
    from lines),
own as (select doc_id, row_number() over () as line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from split),
compared as (
    select doc_id, line, name, 2.0 * len(list_intersect(own.b, known.b)) / (len(own.b) + len(known.b)) as dice
    from own join known on 2 * least(len(own.b), len(known.b)) >= 0.8 * (len(own.b) + len(known.b))),
best as (select doc_id, line, max(dice) as dice, arg_min(name, (-dice, name)) as name from compared where dice >= 0.8 group by doc_id, line),
found as (
    select doc_id, arg_min(name, (-dice, name)) as licence, max(dice) as dice, count(*) as n_matches,
        array_to_string(list_sort(list_distinct(list(name))), ',') as licences
    from best group by doc_id)
select d.doc_id, licence, coalesce(dice, 0.0) as dice, cast(coalesce(n_matches, 0) as bigint) as n_matches, coalesce(licences, '') as licences
from documents d left join found on d.doc_id = found.doc_id
""" % ", ".join(f"('{n}', '{w}')" for n, w in licences.TEMPLATES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every document to be toxic."""
    docs = table(spark, sf_dir, "documents")
    return judged(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 5, 0)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document and the number of its links at five words and a similarity of 0.8."""
    return jaccard.join_rows(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_texts")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows found of every row whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where(F.col("vec_id") % 50 == 0).select("vec_id"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every document to be of good quality."""
    docs = table(spark, sf_dir, "documents")
    return judged(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))), 3, 1)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), pattern()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_iblt_fingerprint": op3_iblt_fingerprint,
    "op4_url_filter": op4_url_filter,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op4_url_filter": OP4_SQL,
    "op5_license_scan": OP5_SQL,
}
