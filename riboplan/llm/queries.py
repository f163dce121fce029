"""The registered queries of this subpackage and the SQL that DuckDB can hold against them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, language_id, ngram_join, packing, quality_rules, substring_dedup, suffix_dedup, toxicity, warc
from .common import read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that a document with a smaller id has, too."""
    out = substring_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = language_id.predict(docs, language_id.fit(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a response record and its two derivatives, with the links between them."""
    made = warc.derive(warc.respond(read(spark, sf_dir, "pages")))
    return made.drop("metadata_record", "conversion_record")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document among those linked by 4-word shingles at 85 percent."""
    return ngram_join.join(read(spark, sf_dir, "documents"), k=4, percent=85).drop("text_hash")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -1, formatted and read back."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"),
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_format.read_back(chat_format.format_chats(rows))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(flat, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss_text"), "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that a document with a smaller id has, too."""
    out = suffix_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts for every document."""
    return quality_rules.quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, tokenized and packed into sequences of 2048 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a model learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = toxicity.predict(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_language_id, op3_warc, op4_decontaminate, op5_ngram_join, op6_chat_format,
        op7_suffix_dedup,
        op8_quality_rules, op9_packing, op10_toxicity,
    )
}

def _op6_sql() -> str:
    t = chat_format.Template()
    escaped = lambda c: "replace(" * len(t.escapes()) + c + "".join(f",'{a}','{b}')" for a, b in t.escapes())
    moves = ",".join(f"'{a}>{b}'" for a, bs in t.moves.items() for b in bs)
    odd = "</s>[INST] ok [/INST]"
    fixed = len(t.start) + len(t.head_end) + len(t.end)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') r, coalesce(text,'') x FROM conversations
 UNION ALL SELECT -1, 0, 'user', '{odd}' UNION ALL SELECT -1, 1, 'assistant', '{odd}'),
 o AS (SELECT *, lag(r,1,'') OVER w p, row_number() OVER w k, count(*) OVER (PARTITION BY conv_id) n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(r,chr(10),x,chr(10)),'' ORDER BY k)) AS turns_sha256,
 CAST(coalesce(sum(length(x)) FILTER (r='assistant'),0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x,'' ORDER BY k) FILTER (r='assistant'),'')) AS loss_sha256,
 CAST(sum({fixed}+length(replace({escaped('r')},chr(10),'%0A'))+length({escaped('x')})) AS BIGINT) AS formatted_chars,
 bool_and(concat(p,'>',r) IN ({moves})) AND max(r) FILTER (k=n)='assistant' AS valid FROM o GROUP BY conv_id"""


def _op8_sql() -> str:
    stop = ",".join(f"'{w}'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws}))
    tests = []
    for r in quality_rules.RULES:
        top, _, below = (x.strip() for x in r.metric.partition("/"))
        ratio = f"{top}/nullif({below or 1},0)"
        tests += [f"coalesce({ratio}>={r.low},true)"] * (r.low is not None) + [f"coalesce({ratio}<={r.high},true)"] * (r.high is not None)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text,'') t, list_filter(regexp_split_to_array(coalesce(text,''),'[\x20\x09-\x0D]+'), lambda x: x<>'') w,
 list_filter(string_split(coalesce(text,''),chr(10)), lambda x: regexp_matches(x,'[^\x20\x09-\x0D]')) l FROM documents),
 g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+4],' ')) c FROM (SELECT doc_id, w, unnest(generate_series(1,len(w)-4)) i FROM d)),
 rep AS (SELECT doc_id, count(DISTINCT i+j) n FROM g, generate_series(0,4) s(j) WHERE c>1 GROUP BY ALL),
 b AS (SELECT doc_id, len(w) n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))),0) AS BIGINT) word_chars,
 length(t)-length(translate(t,'#*$%&|<>','')) n_symbols, len(l)-len(list_distinct(l)) n_dup_lines, coalesce(rep.n,0) n_repeat_words, len(l) n_lines,
 len(list_filter(w, lambda x: lower(x) IN ({stop}))) n_stop_words FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, (n_words<10 OR 100*n_repeat_words>20*n_words) AS base_failed,
 NOT (n_words<10 OR 100*n_repeat_words>20*n_words) AND {" AND ".join(tests)} AS kept FROM b"""


_OP4_SQL = r"""WITH w AS (SELECT 0 kind, doc_id id, list_filter(regexp_split_to_array(lower(coalesce(text,'')),'[^\p{L}\p{N}]+'), lambda x: x<>'') ws FROM documents
 UNION ALL SELECT 1, item_id, list_filter(regexp_split_to_array(lower(coalesce(text,'')),'[^\p{L}\p{N}]+'), lambda x: x<>'') FROM benchmark),
 s AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i+4],' ') g FROM (SELECT *, unnest(generate_series(1,len(ws)-4)) i FROM w)),
 m AS (SELECT id, count(*) m FROM s WHERE kind=1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, m AS n_item, count(*)/m AS containment FROM s d JOIN s b ON d.g=b.g AND d.kind=0 AND b.kind=1
 JOIN m ON m.id=b.id GROUP BY d.id, b.id, m HAVING count(*)*5>=m*4"""

ORACLES = {
    "op4_decontaminate": _OP4_SQL,
    "op6_chat_format": _op6_sql(),
    "op8_quality_rules": _op8_sql(),
}
