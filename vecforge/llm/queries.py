"""The training-data operators as registered queries, `opN_<name>(spark, sf_dir)`, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """A public vocabulary's place; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text from its maximal scoring segments."""
    from . import toxicity

    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op2_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that also start in an earlier document."""
    from . import substring_dedup

    found = substring_dedup.deduplicate(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op3_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as ORC files and read back."""
    from . import token_files
    from .common import new_path

    path = new_path(spark, "tokens")
    token_files.write(documents(spark, sf_dir), path, tokenizer("byte_bpe_50k.json"))
    return token_files.checked(token_files.read(spark, path))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules that vote or abstain, weighed by expectation maximisation."""
    from . import quality_rules

    found = quality_rules.judged(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    from . import packing

    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by a factorisation machine."""
    from . import quality_classifier

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality_classifier.score(docs, quality_classifier.fit(docs, labels, metadata=("n_chars",)))
    return found.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have similarity 0.8 or more."""
    from . import near_dedup

    return near_dedup.classes(documents(spark, sf_dir), params=near_dedup.Params(words=4, percent=80))


def op8_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    from . import exact_dedup

    found = exact_dedup.classes(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's time slot in a mix of the sources at tempered weights, blocks of 64 rows."""
    from . import mixing

    docs = documents(spark, sf_dir)
    return mixing.schedule(docs, mixing.tempered(docs), block_rows=64)


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, by fixed virtual slots; equal texts share a shard."""
    from . import sharding

    rows, _ = sharding.shard(documents(spark, sf_dir), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_trie_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its most frequent spelling at distance one, and the root that these lead to."""
    from . import spelling

    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir)))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    from . import lexical_search

    index = lexical_search.read(spark, lexical_search.index(documents(spark, sf_dir)))
    return lexical_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    from . import line_dedup

    found = line_dedup.deduplicate(documents(spark, sf_dir), min_documents=10, keep_first=False)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxic_segments, op2_count_min_substrings, op3_orc_token_files, op4_weak_supervision, op5_certified_packing, op6_factorisation_machine, op7_minmax_near_dedup, op8_heavy_hitter_dedup, op9_pfair_mixing, op10_virtual_slots, op11_trie_spelling, op12_block_max_search, op13_line_bitmaps)}


def _rules_sql(rounds: int = 40) -> str:
    """op4 in SQL: statistics, votes, and the rounds of expectation maximisation one after another."""
    from .quality_rules import FALSE_ALARM, PRIOR, RULES

    cases = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS vote_{r}" for r, (bad, good) in RULES.items())
    columns = ", ".join(f"vote_{r}" for r in RULES)
    votes = " UNION ALL ".join(f"SELECT p, n, {j} AS j, vote_{r} AS v FROM pat" for j, r in enumerate(RULES))
    grid = ", ".join(f"({j}, {v}, {PRIOR[0][v + 1]}::DOUBLE, {PRIOR[1][v + 1]}::DOUBLE)" for j in range(len(RULES)) for v in (-1, 0, 1))
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"""c{k} AS MATERIALIZED (
  SELECT j, v, CASE WHEN a <= {FALSE_ALARM} THEN g WHEN v = -1 THEN {FALSE_ALARM} ELSE g * (1 - {FALSE_ALARM}) / (1 - a) END AS g, b
  FROM (SELECT j, v, g, b, max(CASE WHEN v = -1 THEN g END) OVER (PARTITION BY j) AS a FROM (
    SELECT j, v, g / sum(g) OVER (PARTITION BY j) AS g, b / sum(b) OVER (PARTITION BY j) AS b FROM (
      SELECT d.j, d.v, d.g + coalesce(m.g, 0) AS g, d.b + coalesce(m.b, 0) AS b FROM grid d
      LEFT JOIN (SELECT j, v, sum(pv.n * q) AS g, sum(pv.n * (1 - q)) AS b FROM pv JOIN q{k - 1} USING (p) GROUP BY j, v) m USING (j, v))))),
q{k} AS MATERIALIZED (
  SELECT p, pv.n, 1 / (1 + exp(-(ln(o / (1 - o)) + sum(ln(g / b))))) AS q FROM pv JOIN c{k} USING (j, v),
    (SELECT least(0.95, greatest(0.05, sum(n * q) / sum(n))) AS o FROM q{k - 1}) GROUP BY p, pv.n, o)""")
    return rf"""WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w)),
u AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM u, range(0, 5) t(k) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda z: regexp_matches(z, '[^\x20\x09-\x0D]')) AS l FROM w),
s AS (SELECT l.doc_id, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
  len(regexp_extract_all(t, '[#*$%&|<>]+')) AS n_symbol_runs, len(regexp_extract_all(t, '[!?]+')) AS n_shouts, len(list_distinct(w)) AS n_distinct,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN r USING (doc_id)),
v AS MATERIALIZED (SELECT *, {cases} FROM s),
pat AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {columns}) AS p, {columns}, n FROM (SELECT {columns}, count(*) AS n FROM v GROUP BY {columns})),
pv AS MATERIALIZED ({votes}),
grid(j, v, g, b) AS MATERIALIZED (VALUES {grid}),
q0 AS MATERIALIZED (SELECT p, n, CASE WHEN min(v) = -1 THEN 0.05 ELSE 0.95 END::DOUBLE AS q FROM pv GROUP BY p, n),
{", ".join(steps)}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, f AS base_failed, NOT f AND q >= 0.5 AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS f FROM v) JOIN pat USING ({columns}) JOIN q{rounds} USING (p)"""


ORACLES = {
    "op4_weak_supervision": _rules_sql(),
    "op2_count_min_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM w),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS x FROM i),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM x),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM m, range(0, 13) r(k) WHERE first < doc_id),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, count(*) FILTER (c.p IS NOT NULL) AS n_removed, coalesce(string_agg(p.w[p.p], ' ' ORDER BY p.p) FILTER (c.p IS NULL), '') AS kept
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
""",
    "op7_minmax_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS id, doc_id AS node FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.node
), c AS (SELECT id, min(node) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.id = s.doc_id
""",
    "op12_block_max_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
q AS (SELECT item_id, t, count(*) AS k FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
p AS (SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t, len(w) AS n FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t, n),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, n_docs),
x AS (SELECT item_id, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM p JOIN q USING (t) JOIN f USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER i)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0
WINDOW i AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER i <= 10
""",
    "op13_line_bitmaps": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(r.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r ON r.key = k.key GROUP BY doc_id
""",
    "op8_heavy_hitter_dedup": r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
""",
}
