"""The queries of this subpackage over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import audit, decontaminate, fingerprint, language, licenses, line_dedup, mixing, near_dedup, pii, prefix_trie, quality, records, toxicity
from tidewatch.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build
    return register


@query("op1_pii")
def _pii(table):
    return pii.pii(table("documents"))


@query("op2_toxicity")
def _toxicity(table):
    return toxicity.toxicity(table("documents"), table("labels"))


@query("op3_decontaminate")
def _decontaminate(table):
    return decontaminate.contaminated(table("documents"), table("benchmark"))


@query("op4_language")
def _language(table):
    return language.language(table("documents"))


@query("op5_licenses")
def _licenses(table):
    return licenses.licenses(table("documents"))


@query("op6_near_dedup")
def _near_dedup(table):
    return near_dedup.near_duplicates(table("documents"), similarity=0.85)


@query("op7_fingerprints")
def _fingerprints(table):
    return fingerprint.fingerprints(table("documents"))


@query("op8_line_dedup", line_dedup.SQL)
def _line_dedup(table):
    return line_dedup.line_dedup(table("documents"))


@query("op9_mixing", mixing.SQL)
def _mixing(table):
    return mixing.mixed(table("documents"))


@query("op10_quality")
def _quality(table):
    return quality.quality(table("documents"), table("labels"))


@query("op11_prefix_trie", prefix_trie.SQL)
def _prefix_trie(table):
    return prefix_trie.prefix_trie(table("conversations"))


@query("op12_token_records")
def _token_records(table):
    from public_tokenizers import path
    return records.token_records(table("documents"), path("word_bpe_49k.json"))


@query("op13_filter_audit", audit.SQL)
def _filter_audit(table):
    return audit.filter_audit(table("documents"), table("labels"))
