"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relloom.llm.common import table
from relloom.llm.curriculum import by_first_copy, curriculum
from relloom.llm.fingerprint import compare_with_next
from relloom.llm.language_id import language_id
from relloom.llm.license_scan import license_scan
from relloom.llm.ngram_join import ngram_join
from relloom.llm.packing import SEQUENCE, SEQUENCE_WEIGHTS, pack
from relloom.llm.piece_lattice import digests, read_pieces
from relloom.llm.quality_rules import quality_rules
from relloom.llm.secret_scan import secret_scan
from relloom.llm.token_alignment import token_alignment
from relloom.llm.tool_calls import SCHEMAS, calls_of_turns, link_tool_calls
from relloom.llm.warc import derivatives
from relloom.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Words, lines and windows as in the operator; the thresholds are those of its table.
QUALITY_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
         row_number() over () as r
  from documents
), windows as (
  select r, unnest(range(1, len(w) - 1)) as i, w from t
), placed as (
  select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from windows
), covered as (
  select r, count(distinct i + k) as n_repeat_words
  from placed, (values (0), (1), (2)) as o(k) where n > 1 group by r
), m as (
  select doc_id, len(w) as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words,
         length(regexp_replace(text, '[^!]', '', 'g')) as n_exclaimed,
         len(list_filter(w, lambda x: x in ({stop}))) as n_stop,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•‣●○]'))) as n_bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as n_cut
  from t left join covered using (r)
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and word_chars between 2 * n_words and 30 * n_words and n_symbols <= 0.25 * n_words
       and n_exclaimed <= 0.3 * n_words and n_stop >= 0.01 * n_words and n_dup_lines <= 0.5 * n_lines
       and n_bullets <= 0.9 * n_lines and n_cut <= 0.5 * n_lines as kept
from b
"""


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


def _quality_sql() -> str:
    from relloom.llm.quality_rules import STOP_WORDS, written

    return QUALITY_SQL.replace("{stop}", _listed(written(STOP_WORDS)))


@query("op6_quality_rules", _quality_sql())
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE, weights=SEQUENCE_WEIGHTS)


@query("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query("op5_warc_derivatives")
def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"))


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read_pieces(spark, tokenizer_path("piece_bpe_32k.model"))
    return digests(table(spark, sf_dir, "documents"), pieces, ["merges", "viterbi"])


@query("op2_tool_calls")
def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of_turns(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, SCHEMAS)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return token_alignment(table(spark, sf_dir, "documents"), *paths, whole=False).withColumnRenamed("groups", "groups_sha256")


# The schedules' integrals are 5, 2 and 1; their inverses are written out.
CURRICULUM_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as mix
  from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as number
  from sized group by source
), weighed as (
  select *, case number % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         (2 * source_size)::double as bound
  from sources
), ranked as (
  select *, coalesce(sum(bound) over before, 0) as bounds, coalesce(sum(weight) over before, 0) as weights,
         1.5::double * sum(source_size) over () as asked, sum(weight) over () as whole
  from weighed
  window before as (order by bound / weight, number rows between unbounded preceding and 1 preceding)
), stopped as (
  select *, (asked - bounds) / (whole - weights) > bound / weight as stops from ranked
), rest as (
  select (max(asked) - coalesce(sum(bound) filter (stops), 0)) / (max(whole) - coalesce(sum(weight) filter (stops), 0)) as each
  from stopped
), targets as (
  select source, source_size, number, case when stops then bound else each * weight end as target from stopped, rest
), placed as (
  select s.*, source_size, number, target, floor(target)::bigint as wanted,
         coalesce(sum(size) over (partition by s.source order by mix, doc_id, size
                                  rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sized s join targets t on s.source is not distinct from t.source
), due as (
  select *, least(greatest(wanted - start, 0), size) + least(greatest(wanted - source_size - start, 0), size) as taken,
         least(case when target > 0 then start / target else 0 end, 1.0::double) as share
  from placed
), inverted as (
  select *, case number % 3
    when 0 then share * 5.0::double / 5.0::double
    when 1 then case when share * 2.0::double - 0.75::double > 0
      then 0.5::double + (sqrt(4.0::double + 4.0::double * (share * 2.0::double - 0.75::double)) - 2) / 2
      else 0.0::double + (sqrt(1.0::double + 4.0::double * (share * 2.0::double)) - 1) / 2 end
    else 0.0::double + (sqrt(greatest(4.0::double - 4.0::double * share, 0)) - 2) / (-2) end as moment
  from due
)
select doc_id, size, source_size, target, taken::bigint as taken,
       case when taken > 0 then least(greatest(moment, 0.0::double), 1.0::double) end as first_at
from inverted
"""


@query("op12_curriculum", CURRICULUM_SQL)
def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_first_copy(curriculum(table(spark, sf_dir, "documents")))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
