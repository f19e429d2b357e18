"""The queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import (compact_windows, context_mixing, decontaminate, fim, jaccard_join, packing, qda, quality_rules,
                          secret_scan, simhash, spelling, suffix_dedup, tokens)
from maskloom.llm.common import table
from maskloom.llm.registry import query


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_sequences(table(spark, sf_dir, "documents"), tokenizer=tokens.WORD_BPE, end_id=1)
    return tokens.read_documents(manifest)


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, labels, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=packing.BYTE_BPE, capacity=1024, end_id=2,
                        payload={"ids_crc32": F.crc32("ids")})


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return out.select(
        "doc_id", size("assign"), size("access"), size("hex"), size("markov"),
        F.sha2(secret_scan.joined("assign", "access", "hex").cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(*secret_scan.KINDS).alias("spans"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_compact_windows")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(table(spark, sf_dir, "documents"))


@query("op3_context_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: Lines by the same expression; draws, cuts and both forms in SQL; the restored text is put together from the parts.
FIM_SQL = """
with drawn as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
lined as (
  select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as lines,
         cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
         cast('0x' || substr(h, 25, 8) as bigint) as h4 from drawn),
cuts as (
  select doc_id, t, lines, len(lines) as n,
         least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form from lined),
parts as (
  select doc_id, t, n, form, array_to_string(lines[1:a], '') as p, array_to_string(lines[a + 1:b], '') as m,
         array_to_string(lines[b + 1:], '') as s from cuts)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(case form when 'plain' then t else p || m || s end) as restored_sha256
from parts
"""


@query("op12_fill_in_middle", FIM_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    return fim.transform(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output"), "output_sha256"),
        digest(fim.restored(), "restored_sha256"))


@query("op13_simhash_golay")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
