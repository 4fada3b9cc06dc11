"""The registered ``opN_<name>`` queries: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .common import documents, learns


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir), keep="max")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), 100).drop("kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (~learns("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_corpus

    docs = documents(spark, sf_dir)
    scored = score_corpus(docs, docs.where(learns("doc_id", 7)))
    return scored.select("doc_id", (~learns("doc_id", 7)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Shares of the tokens that op6 and the pipeline mix to: a language each for good texts, and one for all that is poor. Good texts
#: of any other language are a domain too, which keeps its share.
TARGETS = {"en": 0.45, "fr": 0.20, "de": 0.20, "es": 0.12, "poor": 0.03}


def domain_model(spark: SparkSession, sf_dir: str):
    """Domains of the labelled rows of the whole corpus: the language of good ones, else ``poor``."""
    from .mixing import fit_domains

    docs = documents(spark, sf_dir)
    domain = F.when(F.col("quality") == 1, F.col("lang")).otherwise(F.lit("poor"))
    return fit_domains(docs, documents(spark, sf_dir, "labels"), domain, ["quality"], per_label=4000)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import written
    from .mixing import fit_rates, memberships, with_copies

    model = domain_model(spark, sf_dir)
    members = memberships(documents(spark, sf_dir).select("doc_id", "text"), model).drop("text")
    members = written(members, "mix-members")
    rates = fit_rates(members, model.names, TARGETS)
    named = {x: F.get("posterior", F.lit(k)).alias(f"p_{x}") for k, x in enumerate(model.names)}
    none = {x: F.lit(0.0).alias(f"p_{x}") for x in TARGETS}
    return with_copies(members, rates).select("doc_id", "n_tokens", *(none | named).values(), "rate", "copies", F.lit(rates.gap).alias("gap"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the two labels: 0 is poor, 1 good but toxic, 2 good and not toxic; kept from a chance of one half."""
    from . import quality

    docs = documents(spark, sf_dir)
    grade = F.col("quality") * (2 - F.col("toxic"))
    model = quality.fit(docs, documents(spark, sf_dir, "labels"), grade, ["quality", "toxic"])
    graded = quality.grade_documents(docs.select("doc_id", "text"), model, at_least=1)
    return graded.select("doc_id", (~learns("doc_id")).alias("held_out"), "expected_grade", "tail_prob", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = documents(spark, sf_dir)
    named = langid.predict_languages(docs.select("doc_id", "text"), langid.fit(docs))
    return named.select("doc_id", (~learns("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import Spec, simhash_components

    found = simhash_components(documents(spark, sf_dir), (Spec(4, True, 42),), radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    docs = documents(spark, sf_dir)
    narrow = docs.select(
        "doc_id", "source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard(narrow, n_shards=16, dims=("source", "lang", "size"), text_col=None)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
