"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fencewatch.llm import alignment, bpe, chat, jaccard, neighbours, packing, pages, pii, quality, ranked, repetition, substrings, urls
from fencewatch.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, as the package of these files gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts of the base rule, and the verdict of the repetition rules."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.measured(documents).drop("text")


def op3_trie_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and its component of near duplicates."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every hundredth one."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: What conversation -7 says in both turns: the template's own control strings.
_TRICKY = "</s>[INST] ok [/INST]"


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with one of control strings only."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", _TRICKY), (-7, 1, "assistant", _TRICKY)], turns.schema)
    made = chat.conversations(chat.chain(turns.unionByName(tricky)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat.read_back(made, ["tree_id"]).select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality.learned(documents, table(spark, sf_dir, "labels"))
    return quality.scored(documents, network).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_boosted_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    texts = pages.extracted(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: Listed rules as (verdict, host/path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by listed and mined rules."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(rows, urls.labelled_by_document(rows, table(spark, sf_dir, "labels")), URL_RULES)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    coded = bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data, and counts of those that the fixed patterns find."""
    found = pii.found(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")
    )


def op11_lempel_ziv_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that a document of smaller id holds too."""
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark text."""
    return ranked.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hashed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's links between the tokens of two tokenizers, with the counts of the linked pairs."""
    made = alignment.aligned(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


_OP5_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
  )
), sized AS (
  SELECT *, length(text)
    + len(regexp_extract_all(text, '\\[\\\\*/?(INST|ROLE|TEXT)\\]|<\\\\*/?s>')) AS body
  FROM turns
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(body + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
                                ELSE length(url_encode(role)) + 22 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP11_SQL = r"""
WITH numbered AS (SELECT *, row_number() OVER () AS r FROM documents),
worded AS (SELECT r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM numbered),
windows AS (
  SELECT r, doc_id, unnest(range(1, len(words) - 48)) AS start, words FROM worded WHERE len(words) >= 50),
hashed AS (SELECT r, doc_id, start, md5(array_to_string(words[start:start + 49], ' ')) AS h FROM windows),
firsts AS (SELECT h, min(doc_id) AS low FROM hashed GROUP BY h),
repeated AS (SELECT r, start FROM hashed JOIN firsts USING (h) WHERE doc_id > low),
gone AS (SELECT DISTINCT r, start + unnest(range(50)) AS place FROM repeated),
placed AS (SELECT r, doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM worded),
left_over AS (
  SELECT r, count(*) AS n_words, count(g.place) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY place) FILTER (WHERE g.place IS NULL), '') AS kept
  FROM placed p LEFT JOIN gone g USING (r, place) GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM worded LEFT JOIN left_over USING (r)
"""

_OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS r FROM documents)),
asked AS (
  SELECT item_id, text, term, count(*) AS repeats FROM (
    SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
sizes AS (SELECT r, count(*) AS n FROM split GROUP BY r),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
found AS (SELECT doc_id, r, term, count(*) AS tf FROM split WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM found CROSS JOIN corpus GROUP BY term, docs),
scored AS (
  SELECT item_id, text, doc_id, r,
    CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN found USING (term) JOIN weights USING (term) JOIN sizes USING (r) CROSS JOIN corpus GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_OPERATORS = (
    op1_best_fit_packing, op2_suffix_repetition, op3_trie_jaccard, op4_hilbert_neighbours, op5_reply_trees, op6_byte_network,
    op7_boosted_main_text, op8_url_rules, op9_bpe, op10_semi_markov_pii, op11_lempel_ziv_spans, op12_range_maximum_search,
    op13_hashed_alignment,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {"op5_reply_trees": _OP5_SQL, "op11_lempel_ziv_spans": _OP11_SQL, "op12_range_maximum_search": _OP12_SQL}
