"""One query for each operator with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, divergence, exact_dedup, filter_audit, fingerprints, line_dedup, mixing, ngram_join, packing, pii, simhash, token_counts, toxicity
from .common import read_table

TOKENIZERS = "/opt/tokenizers"
CONTROL = "</s>[INST] ok [/INST]"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    out = toxicity.scored(docs.select("doc_id", "text"), model, "found")
    score = F.col("found.score")
    return out.select("doc_id", toxicity.held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "found.n_sentences", "found.n_offending", "found.worst_score", "found.worst_start", "found.worst_end")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.conversation_digests(chat_format.formatted(chat_format.events_of_turns(turns.unionByName(extra))), in_order=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.drop_boilerplate(docs, F.col("source"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.md5(F.coalesce("clean_text", F.lit("")).cast("binary")).alias("clean_md5"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet").drop("keep_file", "keep_row")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


#: Tree weights for the mixing query and stage: whole numbers, 1 where none is given.
WEIGHTS = {"domain": {"web": 3, "library": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 17


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    """Sources src0 to src9 are taken as the web, others as a library."""
    return docs.withColumn(name, F.when(F.col("source").rlike("^src[0-9]$"), F.lit("web")).otherwise(F.lit("library")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    out = mixing.mixed(docs, share=MIX_SHARE, weights=WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return out.select("doc_id", "domain", "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_chat_format, op3_line_dedup, op4_exact_dedup, op5_ngram_join, op6_token_counts, op7_fingerprints, op8_packing, op9_pii, op10_mixing, op11_simhash, op12_source_divergence, op13_filter_audit]
    return {f.__name__: f for f in own}


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256({_NORM}) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""

_TRIM = r"regexp_replace(l, '^[ \t\r]+|[ \t\r]+$', '', 'g')"
LINES_SQL = rf"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT doc_id, source, i, l, {_TRIM} AS k FROM lines),
counts AS (SELECT source, k, count(DISTINCT doc_id) AS n FROM keyed WHERE k <> '' GROUP BY source, k),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (SELECT c.source, c.k FROM counts c JOIN totals t USING (source) WHERE n >= {line_dedup.LEAST} AND n > {line_dedup.RATIO}::DOUBLE * total)
SELECT d.doc_id, d.source, count(*) AS n_lines, count(b.k) AS n_dropped,
       md5(coalesce(string_agg(d.l, chr(10) ORDER BY d.i) FILTER (WHERE b.k IS NULL), '')) AS clean_md5
FROM keyed d LEFT JOIN bad b ON d.source = b.source AND d.k = b.k
GROUP BY d.doc_id, d.source
"""


def _level(name: str, keys: list[str], up: str | None) -> str:
    """SQL that fills the siblings of one level: cumulated supplies in order of supply by weight."""
    cases = lambda level: " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    weight = f"CASE {cases(keys[-1])} ELSE 1 END" if WEIGHTS[keys[-1]] else "1"
    parent = ", ".join(keys[:-1])
    by = f"PARTITION BY {parent}" if parent else ""
    rank = f"{by} ORDER BY supply::DOUBLE / weight, {keys[-1]}"
    given = f"(SELECT {parent}, budget AS given FROM {up})" if up else "(SELECT budget AS given FROM total)"
    join = f"JOIN {given} USING ({parent})" if up else f"CROSS JOIN {given}"
    return f"""
{name}_n AS (SELECT *, {weight} AS weight FROM (SELECT {", ".join(keys)}, sum(supply) AS supply FROM leaves GROUP BY ALL) {join}),
{name}_c AS (SELECT *, coalesce(sum(supply) OVER ({rank} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
             sum(weight) OVER ({rank} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             row_number() OVER ({rank}) AS place FROM {name}_n),
{name}_f AS (SELECT *, supply * rest <= weight * (given - taken) AS filled FROM {name}_c),
{name}_m AS (SELECT *, first_value(taken) OVER (PARTITION BY {"filled" + (", " + parent if parent else "")} ORDER BY place) AS t0,
             first_value(rest) OVER (PARTITION BY {"filled" + (", " + parent if parent else "")} ORDER BY place) AS w0 FROM {name}_f),
{name} AS (SELECT {", ".join(keys)}, supply, (CASE WHEN filled THEN supply ELSE (weight * (given - t0)) // w0 END)::BIGINT AS budget FROM {name}_m)"""


MIXING_SQL = rf"""
WITH docs AS (SELECT doc_id, lang, source, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'library' END AS domain,
              len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS tokens FROM documents),
sums AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
leaves AS (SELECT domain, lang, source, tokens * {MIX_EPOCHS} AS supply FROM sums WHERE tokens > 0),
total AS (SELECT floor(sum(tokens) * {MIX_SHARE})::BIGINT AS budget FROM sums),
{_level("a", ["domain"], None)},
{_level("b", ["domain", "lang"], "a")},
{_level("c", ["domain", "lang", "source"], "b")},
cut AS (SELECT domain, lang, source, c.budget // s.tokens AS whole, c.budget % s.tokens AS part FROM c JOIN sums s USING (domain, lang, source)),
keyed AS (SELECT d.*, whole, part, md5('{MIX_SEED}:' || whole || ':' || doc_id) AS k FROM docs d JOIN cut USING (domain, lang, source)),
ran AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, unnest(range(whole))::INTEGER AS epoch, tokens FROM ran
UNION ALL SELECT doc_id, domain, lang, source, whole::INTEGER AS epoch, least(tokens, part - upto + tokens)::BIGINT AS tokens FROM ran WHERE part > 0 AND (upto <= part OR upto - tokens < part)
"""


DIVERGENCE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              regexp_extract_all({_NORM}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
found AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM found GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.LEAST}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counted USING (lang, source) GROUP BY ALL),
shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + ((coalesce(n, 0) + 1)::HUGEINT * {divergence.SCALE}) // (total + v) AS p,
           1 + ((lang_n + 1)::HUGEINT * {divergence.SCALE}) // (lang_total + v) AS q
           FROM groups JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""

FILTERS_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
failed AS (SELECT doc_id, part, CASE WHEN len(words) < {filter_audit.MIN_WORDS} THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(words)) < {filter_audit.PERCENT_DISTINCT} * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > {filter_audit.PERCENT_CAPITALS} * length(text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM texts),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM failed LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (SELECT part, filter_order, step::INTEGER AS step, filter,
       coalesce(sum(n) FILTER (WHERE translate(fails, before || filter, '') = fails), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (WHERE contains(fails, filter) AND translate(fails, before, '') = fails), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (WHERE contains(fails, filter) AND translate(fails, before, '') <> fails), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (WHERE fails = filter), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (WHERE contains(fails, filter) AND translate(fails, before, '') = fails), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (WHERE contains(fails, filter) AND translate(fails, before, '') = fails), 0)::BIGINT AS toxic_lost
       FROM cells, steps GROUP BY ALL)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINES_SQL, "op4_exact_dedup": EXACT_SQL, "op10_mixing": MIXING_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_filter_audit": FILTERS_SQL}
