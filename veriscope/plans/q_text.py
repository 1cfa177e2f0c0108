"""Scans, segmentation, extraction and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope.functions import entities as E
from veriscope.functions import text as T
from veriscope.operators import segment
from veriscope.plans.registry import SPACE, WORD, big, query, s_fold, s_norm, s_set, s_tokens, s_trim, table


@query("s3_validate_claims", "SELECT claim_key, id, claim FROM extracted_claims WHERE claim IS NOT NULL AND length(claim) > 0")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").filter(F.length("claim") > 0).select("claim_key", "id", "claim")


@query("s4_labelled_records", "SELECT claim, source_text, label, lang FROM gold")
def _(spark, sf):
    from veriscope.sources.readers import records

    return records(spark, f"{sf}/gold.parquet")


@query("s5_pruned_scan", "SELECT uid, label FROM gold")
def _(spark, sf):
    return table(spark, sf, "gold").select("uid", "label")


@query("s6_numbered_sources", "SELECT coalesce(group_id, '') AS group_id, source_index, coalesce(source_path, '') AS source_path, length(text) AS n FROM sources")
def _(spark, sf):
    return table(spark, sf, "sources").select(F.coalesce("group_id", F.lit("")).alias("group_id"), "source_index", F.coalesce("source_path", F.lit("")).alias("source_path"), big(F.length("text")).alias("n"))


@query("s7_event_claims", "SELECT answer_id || ':' || claim AS k, claim, 'high' AS effort FROM extracted_claims WHERE claim IS NOT NULL")
def _(spark, sf):
    from veriscope.sources.readers import events

    e = table(spark, sf, "extracted_claims").filter("claim is not null").select(F.to_json(F.struct(F.array("claim").alias("claims"), F.array(F.array("answer_id")).alias("sources"))).alias("value"))
    return events(e).select(F.concat(F.col("sources")[0], F.lit(":"), "claim").alias("k"), "claim", "effort")


@query("s10_trace_evidence", f"""WITH t AS (SELECT DISTINCT group_id, {s_norm("regexp_replace('<p>' || text || '</p>', '<[^>]*>', ' ', 'g')")} AS x FROM sources WHERE group_id IS NOT NULL AND text IS NOT NULL AND text NOT LIKE '%&%;%')
 SELECT group_id, (sum(length(x)) + 2 * (count(*) - 1))::BIGINT AS n_chars, count(*) AS n FROM t WHERE length(x) > 80 GROUP BY 1""")
def _(spark, sf):
    from veriscope.sources.readers import trace_evidence

    s = table(spark, sf, "sources").filter("group_id is not null and text is not null and text not like '%&%;%'").select("group_id", F.lit("tool").alias("type"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("output"))
    e = trace_evidence(s, "group_id")
    return e.select("group_id", big(F.length("evidence")).alias("n_chars"), big(F.size(F.split("evidence", "\n\n"))).alias("n"))


@query("t1_normalised", f"SELECT claim_key, {s_norm('claim')} AS norm FROM extracted_claims")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").select("claim_key", T.normalize_whitespace("claim").alias("norm"))


@query("t2_token_counts", f"SELECT doc_id, len({s_tokens('text')}) AS n_tokens, len({s_set('text')}) AS n_distinct FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", big(F.size(T.tokens("text"))).alias("n_tokens"), big(F.size(T.token_set("text"))).alias("n_distinct"))


_PASSAGES = f"""l AS (SELECT source_key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM sources WHERE text IS NOT NULL),
 m AS (SELECT *, lag(line) OVER (PARTITION BY source_key ORDER BY i) AS prev, regexp_full_match(line, '{SPACE}*') AS blank FROM l),
 k AS (SELECT *, sum(CASE WHEN line = '' OR prev IS NULL OR prev = '' OR (blank AND i < n) THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY i) AS island FROM m),
 p AS (SELECT source_key, island, string_agg(line, chr(10) ORDER BY i) AS text FROM k WHERE line <> '' GROUP BY 1, 2)"""


@query("t3_passages", f"WITH {_PASSAGES} SELECT source_key, row_number() OVER (PARTITION BY source_key ORDER BY island) - 1 AS passage_no, text FROM p WHERE regexp_matches(text, '{WORD}')")
def _(spark, sf):
    out = segment.line_passages(table(spark, sf, "sources"), ["source_key"])
    return out.select("source_key", big("passage_no").alias("passage_no"), "text")


@query("t4_passages_with_fallback")
def _(spark, sf):
    return segment.passages(table(spark, sf, "sources"), ["source_key"])


@query("t5_recursive_chunks")
def _(spark, sf):
    return segment.chunks(table(spark, sf, "sources"), ["source_key"])


@query("t6_sentences", r"SELECT claim_key, len(string_split(regexp_replace(claim, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS n FROM extracted_claims WHERE claim IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").filter("claim is not null").select("claim_key", big(F.size(F.split("claim", r"(?<=[.!?])\s+"))).alias("n"))


@query("t7_word_windows", None)
def _(spark, sf):
    from veriscope.functions import kernels as K

    return segment._explode_spans(table(spark, sf, "sources"), ["source_key"], "text", lambda t: K.word_windows(t, 0, 300, 30), "window_no")


@query("t8_merged_chunks", None)
def _(spark, sf):
    from veriscope.functions import kernels as K

    return segment._explode_spans(table(spark, sf, "sources"), ["source_key"], "text", lambda t: K.merge_adjacent(K.loose_sentences(t, 0), 300), "chunk_no")


@query("t9_view_chunks", None)
def _(spark, sf):
    return segment.view_chunks(table(spark, sf, "sources"), ["source_key"])


@query("t10_cascade_chunks", None)
def _(spark, sf):
    return segment.chunks(table(spark, sf, "sources").filter("group_id is not null"), ["group_id", "source_index"], most=1500).drop("char_start", "char_end")


@query("t11_char_windows", "SELECT source_key, len(range(0, length(text), 900)) AS n, substring(text, 1, 1000) AS first FROM sources WHERE length(text) > 0")
def _(spark, sf):
    w = T.char_windows("text", 1000, 100)
    return table(spark, sf, "sources").filter(F.length("text") > 0).select("source_key", big(F.size(w)).alias("n"), w[0].alias("first"))


@query("t12_packed_sentences", None)
def _(spark, sf):
    return segment.packed_sentences(table(spark, sf, "sources"), ["source_key"])


@query("t13_capped_windows", "SELECT source_key, least(50, len(range(0, length(text), 900))) AS n FROM sources WHERE length(text) > 0")
def _(spark, sf):
    return table(spark, sf, "sources").filter(F.length("text") > 0).select("source_key", big(F.size(T.char_windows("text", 1100, 200, 50))).alias("n"))


@query("t14_char_ngrams", f"""WITH t AS (SELECT claim_key, unnest({s_tokens('claim')}) AS w FROM extracted_claims), m AS (SELECT claim_key, '#' || w || '#' AS w FROM t), g AS (SELECT claim_key, w, unnest([3, 4, 5]) AS n FROM m)
 SELECT claim_key, sum(greatest(0, length(w) - n + 1))::BIGINT AS n_grams, count(DISTINCT substring(w, 1, 3)) AS n_heads FROM g GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "extracted_claims").select("claim_key", T.char_ngrams("claim").alias("g"), T.tokens("claim").alias("t")).filter(F.size("t") > 0)
    heads = F.array_distinct(F.transform("t", lambda w: F.substring(F.concat(F.lit("#"), w, F.lit("#")), 1, 3)))
    return e.select("claim_key", big(F.size("g")).alias("n_grams"), big(F.size(heads)).alias("n_heads"))


@query("t15_accent_free", None)
def _(spark, sf):
    from veriscope.functions.kernels import strip_accents

    @F.pandas_udf("string")
    def bare(x):  # noqa: ANN001, ANN202
        return x.map(lambda s: strip_accents(s) if s is not None else None)

    return table(spark, sf, "extracted_claims").select("claim_key", bare("claim").alias("bare"))


@query("t16_phonetic", rf"""WITH w AS (SELECT DISTINCT unnest({s_tokens('claim')}) AS w FROM extracted_claims), r AS (SELECT w, regexp_replace(substring(w, 2), '[aeiou]', '', 'g') AS rest FROM w)
 SELECT w, length(substring(w, 1, 1) || rest) AS longest FROM r""")
def _(spark, sf):
    w = table(spark, sf, "extracted_claims").select(F.explode(T.tokens("claim")).alias("w")).distinct()
    return w.select("w", big(F.length(F.substring("w", 1, 1)) + F.length(F.regexp_replace(F.substring("w", 2, 1_000_000), "[aeiou]", ""))).alias("longest"))


@query("t16_skeletons", None)
def _(spark, sf):
    w = table(spark, sf, "extracted_claims").select(F.explode(T.tokens("claim")).alias("w")).distinct()
    return w.select("w", T.phonetic("w").alias("skeleton"))


@query("t17_clauses", None)
def _(spark, sf):
    return segment.clauses(table(spark, sf, "extracted_claims").select("claim_key", F.col("claim").alias("text")), ["claim_key"])


@query("t18_long_sentences", r"""WITH x AS (SELECT source_key, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM sources WHERE text IS NOT NULL)
 SELECT source_key, count(*) AS n FROM x WHERE length(regexp_replace(s, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) >= 20 GROUP BY 1""")
def _(spark, sf):
    s = F.filter(T.sentences("text"), lambda x: F.length(T.trim(x)) >= 20)
    return table(spark, sf, "sources").select("source_key", big(F.size(s)).alias("n")).filter("n > 0")


@query("t22_hash_codepoints", "SELECT DISTINCT c, list_transform([31, 43, 59, 61, 73, 97, 103, 113], lambda p: ((c + 1) * p) % 8192) AS h FROM (SELECT unicode(unnest(string_split(code || name, ''))) AS c FROM languages)")
def _(spark, sf):
    c = table(spark, sf, "languages").select(F.explode(F.split(F.concat("code", "name"), "")).alias("ch")).filter("ch <> ''").select(F.ascii("ch").alias("c")).distinct()
    return c.select("c", T.hash_codepoint(F.col("c")).alias("h"))


_LINES = rf"""l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{0085}}\x{{2028}}\x{{2029}}]')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{0085}}\x{{2028}}\x{{2029}}]'), 1) AS line_no FROM documents WHERE text IS NOT NULL),
 q AS (SELECT doc_id, line_no, regexp_replace(line, '^{SPACE}+', '') AS s FROM l), r AS (SELECT *, CASE WHEN starts_with(s, '>') THEN {s_trim("regexp_replace(s, '^[> ]+', '')")} ELSE s END AS q FROM q),
 b AS (SELECT doc_id, line_no, CASE WHEN starts_with(s, '#') OR starts_with(q, '|') THEN '' ELSE {s_trim(f"regexp_replace(q, '^(?:[-*+]|[0-9]+[.)]){SPACE}+', '')")} END AS bare FROM r)"""


@query("e1_markdown_lines", f"WITH {_LINES} SELECT doc_id, line_no, bare FROM b")
def _(spark, sf):
    return segment.lines(table(spark, sf, "documents").filter("text is not null"), "doc_id").select("doc_id", big("line_no").alias("line_no"), T.strip_markdown("line").alias("bare"))


_PARAS = f"""{_LINES}, i AS (SELECT *, sum(CASE WHEN bare = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM b),
 para AS (SELECT doc_id, k, min(line_no) AS line_no, string_agg(bare, ' ' ORDER BY line_no) AS text FROM i WHERE bare <> '' GROUP BY 1, 2)"""


@query("e2_paragraphs", f"WITH {_PARAS} SELECT doc_id, line_no, text FROM para")
def _(spark, sf):
    p = segment.paragraphs(table(spark, sf, "documents").filter("text is not null"), "doc_id")
    return p.select("doc_id", big("line_no").alias("line_no"), "text")


_VERB = r"regexp_matches(claim, '(?i)(?:^|[^A-Za-z0-9_])(?:is|are|was|were|has|have|had|will|can|should|must)(?:$|[^A-Za-z0-9_])') OR regexp_matches(claim, '[A-Za-z0-9_](?:ed|ing|s)(?:$|[^A-Za-z0-9_])')"


@query("e3_claim_gate", f"SELECT claim_key, length(claim) >= 20 AND ({_VERB}) AS passes FROM extracted_claims WHERE claim IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").filter("claim is not null").select("claim_key", T.looks_like_claim("claim").alias("passes"))


@query("e4_line_offsets", "WITH l AS (SELECT source_key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM sources WHERE text IS NOT NULL) SELECT source_key, line_no, (sum(length(line) + 1) OVER (PARTITION BY source_key ORDER BY line_no) - length(line) - 1)::BIGINT AS char_start FROM l")
def _(spark, sf):
    # the running sum is kept in one array, so the text is gone through once
    starts = F.aggregate(F.split("text", "\n"), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)))
    s = table(spark, sf, "sources").filter("text is not null").select("source_key", F.posexplode(F.slice(starts, 1, F.size(starts) - 1)).alias("i", "char_start"))
    return s.select("source_key", big(F.col("i") + 1).alias("line_no"), big("char_start").alias("char_start"))


_SENT = rf"""sent AS (SELECT doc_id, line_no, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS claim, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS s FROM para)"""


@query("e6_extract_claims", f"""WITH {_PARAS}, {_SENT}, c AS (SELECT doc_id, line_no, s, {s_trim('claim')} AS claim FROM sent WHERE length({s_trim('claim')}) >= 20), k AS (SELECT * FROM c WHERE {_VERB})
 SELECT doc_id, 'c' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, s) AS VARCHAR), greatest(2, length(CAST(count(*) OVER (PARTITION BY doc_id) AS VARCHAR)))::INT, '0') AS id, line_no AS line_number, claim FROM k""")
def _(spark, sf):
    return segment.extract_claims(table(spark, sf, "documents").filter("text is not null"), "doc_id").withColumn("line_number", big("line_number"))


@query("e5_relocated_claims", None)
def _(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return segment.relocate(segment.extract_claims(d, "doc_id"), d, "doc_id")


@query("e7_agnostic_gate", f"SELECT claim_key, length(claim) >= 20 AND len({s_tokens('claim')}) >= 4 AS passes FROM extracted_claims WHERE claim IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").filter("claim is not null").select("claim_key", T.agnostic_gate("claim").alias("passes"))


@query("e8_content_gate", f"SELECT claim_key, len(list_filter({s_tokens('claim')}, lambda t: regexp_matches(t, '\\p{{L}}'))) >= 3 AS passes FROM extracted_claims")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").select("claim_key", T.content_gate("claim").alias("passes"))


@query("e9_extraction_variants", f"""WITH {_PARAS}, {_SENT}, c AS (SELECT doc_id, {s_trim('claim')} AS claim FROM sent WHERE length({s_trim('claim')}) >= 20)
 SELECT doc_id, count(*) FILTER (WHERE {_VERB}) AS verb, count(*) FILTER (WHERE len({s_tokens('claim')}) >= 4) AS agnostic FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE {_VERB}) > 0 AND count(*) FILTER (WHERE len({s_tokens('claim')}) >= 4) > 0""")
def _(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    a, b = (segment.extract_claims(d, "doc_id", gate=g).groupBy("doc_id").agg(F.count(F.lit(1)).alias(g)) for g in ("verb", "agnostic"))
    return a.join(b, "doc_id")


@query("e10_claim_types", r"""SELECT claim_key, CASE WHEN regexp_matches(claim, '["«„“「]') THEN 'quote' WHEN regexp_matches(claim, '\d') THEN 'numeric' WHEN regexp_matches(lower(claim), 'according to|says|reports') THEN 'attribution' ELSE 'assertion' END AS kind, regexp_matches(claim, '[?？؟]') AS question FROM extracted_claims WHERE claim IS NOT NULL""")
def _(spark, sf):
    c = F.col("claim")
    kind = F.when(c.rlike('["«„“「]'), "quote").when(c.rlike(r"\d"), "numeric").when(F.lower(c).rlike("according to|says|reports"), "attribution").otherwise("assertion")
    return table(spark, sf, "extracted_claims").filter("claim is not null").select("claim_key", kind.alias("kind"), c.rlike("[?？؟]").alias("question"))


@query("e11_without_references", "SELECT doc_id, CASE WHEN contains(text, '\n## ') THEN string_split(text, '\n## ')[1] ELSE text END AS head FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n## ", 1).alias("head"))


_NUMS = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_RX = rf"({_NUMS})\s*({E.UNIT})?(?:\s*({E.CONTEXT}))?"
_VAL = "CASE WHEN contains(v0, '.') THEN regexp_replace(regexp_replace(regexp_replace(v0, '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '^0+(\\d)', '\\1') ELSE v0 END"
S_NUMBERS = f"""n0 AS (SELECT claim_key, unnest(regexp_extract_all(claim, '{_RX}', 1)) AS v, unnest(regexp_extract_all(claim, '{_RX}', 2)) AS u, unnest(regexp_extract_all(claim, '{_RX}', 3)) AS w FROM extracted_claims),
 n1 AS (SELECT claim_key, replace(v, ',', '') AS v0, CASE WHEN lower(u) = 'percent' THEN '%' ELSE coalesce(lower(u), '') END AS unit, CASE WHEN lower(w) IN ({', '.join(repr(x) for x in E.NO_CONTEXT)}) THEN '' ELSE coalesce(lower(w), '') END AS w FROM n0),
 n2 AS (SELECT claim_key, {_VAL} AS value, unit, w FROM n1),
 n3 AS (SELECT claim_key, value, unit, CASE WHEN unit = '' AND w = '' AND regexp_full_match(value, '{E.YEAR}') THEN 'year' ELSE w END AS context FROM n2),
 nums AS (SELECT * FROM n3 WHERE unit <> '' OR context <> '' OR length(value) > 1)"""


@query("fp1_numbers_of_claims", f"WITH {S_NUMBERS} SELECT claim_key, value, unit, context FROM nums")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").select("claim_key", F.explode(E.numbers_column(F.col("claim"))).alias("x")).select("claim_key", "x.value", "x.unit", "x.context")


@query("fp2_years", f"WITH y AS (SELECT claim_key, unnest(regexp_extract_all(claim, '(?:^|[^\\p{{L}}\\p{{N}}_])({E.YEAR})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) AS year FROM extracted_claims) SELECT DISTINCT claim_key, year FROM y")
def _(spark, sf):
    return table(spark, sf, "extracted_claims").select("claim_key", F.explode(F.regexp_extract_all("claim", F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_])({E.YEAR})(?:$|[^\p{{L}}\p{{N}}_])"), F.lit(1))).alias("year")).distinct()


@query("fp5_comparatives", f"WITH c AS (SELECT claim_key, unnest(regexp_extract_all(claim, '(?i){E.COMPARATIVE}({_NUMS})', 1)) AS v0 FROM extracted_claims), d AS (SELECT claim_key, replace(v0, ',', '') AS v0 FROM c) SELECT claim_key, {_VAL} AS value FROM d")
def _(spark, sf):
    raw = F.regexp_extract_all("claim", F.lit(f"(?i){E.COMPARATIVE}({E.VALUE})"), F.lit(1))
    return table(spark, sf, "extracted_claims").select("claim_key", F.explode(raw).alias("v")).select("claim_key", E.value_column(F.col("v")).alias("value"))


@query("fp3_values_fp4_units", f"WITH {S_NUMBERS} SELECT unit, count(*) AS n, count(DISTINCT value) AS n_values, min(value) AS least FROM nums GROUP BY 1")
def _(spark, sf):
    x = table(spark, sf, "extracted_claims").select(F.explode(E.numbers_column(F.col("claim"))).alias("x")).select("x.*")
    return x.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"), F.min("value").alias("least"))


@query("fp6_fixed_names", "WITH n AS (SELECT doc_id, unnest(['AWS', 'Azure', 'GCP', 'OCI', 'T4', 'L4', 'M1', 'M2', 'A10', 'K80']) AS name, text FROM documents) SELECT doc_id, name FROM n WHERE regexp_matches(text, '(?:^|[^A-Za-z0-9])' || name || '(?:$|[^A-Za-z0-9])')")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(E.names_column(F.col("text"))).alias("x")).select("doc_id", "x.name")
    return d.filter(F.col("name").isin("AWS", "Azure", "GCP", "OCI", "T4", "L4", "M1", "M2", "A10", "K80"))


@query("fp7_phrases_fp8_entities", None)
def _(spark, sf):
    @F.pandas_udf("struct<phrases:array<string>,entities:array<string>>")
    def both(x):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([(E.phrases(s), E.entities(s or "")) for s in x], columns=["phrases", "entities"])

    return table(spark, sf, "extracted_claims").select("claim_key", both("claim").alias("x")).select("claim_key", "x.*")


@query("fp9_absent_numbers", "WITH r AS (SELECT row_id, source_text, unnest(list_distinct(regexp_extract_all(claim, '\\d+'))) AS n FROM gold WHERE source_text IS NOT NULL) SELECT row_id, count(*) AS n, count(*) FILTER (WHERE NOT contains(source_text, n)) AS n_absent FROM r GROUP BY 1")
def _(spark, sf):
    r = table(spark, sf, "gold").filter("source_text is not null").select("row_id", "source_text", F.array_distinct(F.regexp_extract_all("claim", F.lit(r"\d+"), F.lit(0))).alias("ns")).filter(F.size("ns") > 0)
    return r.select("row_id", big(F.size("ns")).alias("n"), big(F.size(F.filter("ns", lambda x: ~F.contains("source_text", x)))).alias("n_absent"))


@query("fp9_absent_entities_fp10_numeric_fp11_names_fp12_both", None)
def _(spark, sf):
    @F.pandas_udf("struct<absent:array<string>,numeric:int,names:int>")
    def compare(c, s):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([(E.absent(a, b), len(E.number_conflicts(a, b)), len(E.name_conflicts(a, b))) for a, b in zip(c.fillna(""), s.fillna(""))], columns=["absent", "numeric", "names"])

    return table(spark, sf, "gold").select("row_id", compare("claim", "source_text").alias("x")).select("row_id", "x.*")


_RUN = r"\d[\d.,\x{00a0}\x{202f} ]*\d|\d"


def _s_var(x: str) -> str:
    base = f"regexp_replace({x}, '^[ .,\\x{{00a0}}\\x{{202f}}]+|[ .,\\x{{00a0}}\\x{{202f}}]+$', '', 'g')"
    return f"list_filter([{base}, replace({base}, ',', '.'), replace({base}, '.', ','), regexp_replace({base}, '[.,\\x{{00a0}}\\x{{202f}} ]', '', 'g')], lambda z: z <> '')"


@query("fp13_variants_fp14_number_recall", f"""WITH x AS (SELECT row_id, regexp_extract_all(claim, '{_RUN}') AS mine, flatten(list_transform(coalesce(regexp_extract_all(source_text, '{_RUN}'), []), lambda y: {_s_var('y')})) AS theirs FROM gold)
 SELECT row_id, CASE WHEN len(mine) > 0 THEN round(len(list_filter(mine, lambda m: len(list_intersect({_s_var('m')}, theirs)) > 0))::DOUBLE / len(mine), 6) ELSE -1.0 END AS number_recall FROM x""")
def _(spark, sf):
    return table(spark, sf, "gold").select("row_id", F.round(E.number_recall_column(F.col("claim"), F.coalesce("source_text", F.lit(""))), 6).alias("number_recall"))


@query("fp15_anchor_fp16_specificity_fp17_conflict", None)
def _(spark, sf):
    from veriscope.operators.features import best_chunks, pair_features

    return pair_features(best_chunks(table(spark, sf, "gold"), "row_id"), "row_id", "claim", "source_text", "best")


@query("fp16_number_density", f"SELECT claim_key, round(len(regexp_extract_all(claim, '\\d+'))::DOUBLE / greatest(1, len({s_tokens('claim')})), 6) AS density FROM extracted_claims WHERE claim IS NOT NULL")
def _(spark, sf):
    n = F.regexp_count("claim", F.lit(r"\d+"))
    return table(spark, sf, "extracted_claims").filter("claim is not null").select("claim_key", F.round(n / F.greatest(F.lit(1), F.size(T.tokens("claim"))), 6).alias("density"))


@query("fp18_rarity", f"WITH t AS (SELECT unnest({s_tokens('text')}) AS term FROM sources), c AS (SELECT term, count(*) AS n FROM t GROUP BY 1) SELECT term, round(-log10(n::DOUBLE / sum(n) OVER ()), 6) AS rarity FROM c")
def _(spark, sf):
    from veriscope.operators.features import rarity

    return rarity(table(spark, sf, "sources")).withColumn("rarity", F.round("rarity", 6))


@query("fp19_gap_rarity", f"""WITH t AS (SELECT unnest({s_tokens('text')}) AS term FROM sources), c AS (SELECT term, count(*) AS n FROM t GROUP BY 1), b AS (SELECT term, -log10(n::DOUBLE / sum(n) OVER ()) AS rarity FROM c),
 w AS (SELECT row_id, unnest(list_filter({s_set('claim')}, lambda z: length(z) > 1)) AS term, {s_set('source_text')} AS s FROM gold), x AS (SELECT row_id, coalesce(rarity, 9.0) AS r, list_contains(s, term) AS held FROM w LEFT JOIN b USING (term))
 SELECT g.row_id, coalesce(round(coalesce(sum(r) FILTER (WHERE NOT held), 0) / sum(r), 6), 0.0) AS unmatched_rarity, coalesce(round(coalesce(max(r) FILTER (WHERE NOT held), 0) / 9.0, 6), 0.0) AS max_unmatched FROM gold g LEFT JOIN x USING (row_id) GROUP BY 1""")
def _(spark, sf):
    from veriscope.operators.features import gap_rarity, rarity

    out = gap_rarity(table(spark, sf, "gold"), rarity(table(spark, sf, "sources")), "row_id", "claim", "source_text")
    return out.select("row_id", F.round("unmatched_rarity", 6).alias("unmatched_rarity"), F.round("max_unmatched", 6).alias("max_unmatched"))


_STOP = {"en": ["the", "of", "and", "was", "that"], "fr": ["le", "la", "les", "que", "et"], "de": ["der", "die", "das", "und", "nicht"], "es": ["el", "los", "que", "y", "por"], "it": ["il", "che", "di", "non", "gli"]}


def _hits(t, words):
    return F.size(F.filter(t, lambda z: z.isin(words)))


def _vote_sql() -> str:
    votes = ", ".join(f"{{'n': len(list_filter(t, lambda z: z IN ({', '.join(repr(w) for w in ws)}))), 'l': '{lang}'}}" for lang, ws in sorted(_STOP.items()))
    return f"""WITH x AS (SELECT claim_key, {s_tokens('claim')} AS t, length(claim) AS len FROM extracted_claims WHERE claim IS NOT NULL), v AS (SELECT claim_key, len, unnest([{votes}]) AS v, len(t) AS k FROM x),
 r AS (SELECT claim_key, len, v.l AS l, v.n AS n, sum(v.n) OVER (PARTITION BY claim_key) AS total, row_number() OVER (PARTITION BY claim_key ORDER BY v.n DESC, v.l) AS r FROM v)
 SELECT claim_key, CASE WHEN len < 25 OR n = 0 THEN 'und' ELSE l END AS lang, CASE WHEN len >= 25 AND n > 0 AND n::DOUBLE / total >= 0.65 THEN l ELSE 'und' END AS confident FROM r WHERE r = 1"""


@query("fp20_language_fp21_confident", _vote_sql())
def _(spark, sf):
    t = T.tokens("claim")
    votes = [F.struct((-_hits(t, ws)).alias("n"), F.lit(lang).alias("l")) for lang, ws in sorted(_STOP.items())]
    x = table(spark, sf, "extracted_claims").filter("claim is not null").select("claim_key", F.length("claim").alias("len"), F.array_sort(F.array(*votes)).alias("v"))
    n, total = -F.col("v")[0]["n"], F.aggregate("v", F.lit(0), lambda a, y: a - y["n"])
    best = F.col("v")[0]["l"]
    fits = (F.col("len") >= 25) & (n > 0)
    return x.select("claim_key", F.when(fits, best).otherwise("und").alias("lang"), F.when(fits & (n / total >= 0.65), best).otherwise("und").alias("confident"))


def _antonym_sql() -> str:
    from veriscope.operators.features import ANTONYMS

    pairs = ANTONYMS + [(b, a) for a, b in ANTONYMS]
    return f"""WITH a(w, o) AS (VALUES {', '.join(f"('{x}', '{y}')" for x, y in pairs)}), t AS (SELECT row_id, {s_set('claim')} AS c, {s_set('source_text')} AS s FROM gold)
 SELECT row_id, coalesce(bool_or(list_contains(c, w) AND NOT list_contains(s, w) AND list_contains(s, o)), false) AS flip FROM t CROSS JOIN a GROUP BY 1"""


@query("fp22_antonyms_fp23_flip", _antonym_sql())
def _(spark, sf):
    from veriscope.operators.features import antonym_flip

    return table(spark, sf, "gold").select("row_id", antonym_flip(F.col("claim"), F.col("source_text")).alias("flip"))


@query("fp24_low_tier_features_fp40_head", None)
def _(spark, sf):
    from veriscope.operators.features import head, low_tier, rarity

    return low_tier(table(spark, sf, "gold"), rarity(table(spark, sf, "sources"))).withColumn("probability", head("low"))


@query("fp25_translation_gate_fp26_available", "SELECT row_id, lang_norm IS NOT NULL AND lang_norm NOT IN ('en', 'und', '') AS asks, coalesce(CASE WHEN lang_norm IN ('no', 'nn') THEN 'nb' ELSE lang_norm END IN ('de', 'fr', 'es', 'it', 'nb', 'sv', 'da', 'nl', 'pt'), false) AS available FROM gold")
def _(spark, sf):
    n = F.col("lang_norm")
    code = F.when(n.isin("no", "nn"), "nb").otherwise(n)
    return table(spark, sf, "gold").select("row_id", (n.isNotNull() & ~F.coalesce(n, F.lit("")).isin("en", "und", "")).alias("asks"), F.coalesce(code.isin("de", "fr", "es", "it", "nb", "sv", "da", "nl", "pt"), F.lit(False)).alias("available"))


@query("fp27_blocked", "SELECT g.row_id, coalesce(lower(g.lang_norm) <> lower(s.lang) AND lower(g.lang_norm) NOT IN ('en', 'de', 'fr'), false) AS blocked FROM gold g LEFT JOIN (SELECT group_id, min(lang) FILTER (WHERE source_index = 0) AS lang FROM sources GROUP BY 1) s USING (group_id)")
def _(spark, sf):
    s = table(spark, sf, "sources").groupBy("group_id").agg(F.min(F.when(F.col("source_index") == 0, F.col("lang"))).alias("s_lang"))
    n = F.lower("lang_norm")
    g = table(spark, sf, "gold").join(s, "group_id", "left")
    return g.select("row_id", F.coalesce((n != F.lower("s_lang")) & ~n.isin("en", "de", "fr"), F.lit(False)).alias("blocked"))


@query("fp45_negated", f"SELECT row_id, len(list_intersect({s_tokens('claim')}, ['not', 'no', 'never', 'nothing', 'nobody', 'nicht', 'ikke', 'pas', 'non'])) > 0 AS negated FROM gold")
def _(spark, sf):
    cues = F.array(*map(F.lit, ["not", "no", "never", "nothing", "nobody", "nicht", "ikke", "pas", "non"]))
    return table(spark, sf, "gold").select("row_id", F.arrays_overlap(T.tokens("claim"), cues).alias("negated"))


@query("fp46_meta_claims", "SELECT row_id, regexp_matches(lower(claim), 'not found|no passage|nothing in chunk|unclear|unklar|uklart|no evidence') AS meta FROM gold")
def _(spark, sf):
    return table(spark, sf, "gold").select("row_id", F.lower("claim").rlike("not found|no passage|nothing in chunk|unclear|unklar|uklart|no evidence").alias("meta"))


@query("fp47_hedges", f"SELECT row_id, round(len(list_filter({s_tokens('claim')}, lambda z: z IN ('may', 'might', 'could', 'reportedly', 'perhaps')))::DOUBLE / greatest(1, len({s_tokens('claim')})), 6) AS hedges FROM gold")
def _(spark, sf):
    t = T.tokens("claim")
    return table(spark, sf, "gold").select("row_id", F.round(F.size(F.filter(t, lambda z: z.isin("may", "might", "could", "reportedly", "perhaps"))) / F.greatest(F.lit(1), F.size(t)), 6).alias("hedges"))


@query("fp50_lang_norm_fp51_group_hash_fp52_text_hash", "SELECT row_id, string_split(lower(lang), '-')[1] AS lang_base, substr(sha1(source_text), 1, 12) AS group_hash, substr(sha1(claim), 1, 16) AS claim_hash FROM gold")
def _(spark, sf):
    return table(spark, sf, "gold").select("row_id", T.lang_base("lang").alias("lang_base"), T.group_hash("source_text").alias("group_hash"), T.text_hash("claim").alias("claim_hash"))


@query("fp54_label_json", "SELECT judgment_id, uid, upper(label) AS verdict FROM judgments WHERE label IS NOT NULL")
def _(spark, sf):
    # answers around a JSON list, parsed from the first bracket to the last
    j = table(spark, sf, "judgments").filter("label is not null").select("judgment_id", "uid", F.concat(F.lit("Here: "), F.to_json(F.array(F.struct(F.lit(1).alias("n"), F.col("label").alias("verdict")))), F.lit(" done.")).alias("answer"))
    body = F.regexp_extract("answer", r"(?s)\[.*\]", 0)
    got = F.filter(F.from_json(body, "array<struct<n:int,verdict:string>>"), lambda x: (x["n"] >= 1) & (x["n"] <= 1))
    return j.select("judgment_id", "uid", F.upper(got[0]["verdict"]).alias("verdict"))


@query("x_fold_check", f"SELECT count(*) AS n, count(DISTINCT {s_fold('claim')}) AS n_folded FROM gold")
def _(spark, sf):
    return table(spark, sf, "gold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(T.fold("claim")).alias("n_folded"))


@query("f8_passages_as_rows", f"WITH {_PASSAGES} SELECT source_key, count(*) AS n FROM p WHERE regexp_matches(text, '{WORD}') GROUP BY 1")
def _(spark, sf):
    return segment.line_passages(table(spark, sf, "sources"), ["source_key"]).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))



