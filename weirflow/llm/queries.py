"""The ``opN_`` queries and their SQL, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .common import fresh_path, table
from .exact_dedup import exact_dedup
from .langid import fit, held_out, identify
from .mixing import BUCKET_ROWS, mix_sources
from .near_dedup import near_dedup
from .packing import pack
from .quality import RULES, SEQUENCE, quality_rules
from .suffix_dedup import suffix_dedup
from .tokenfile import read_tokens, write_tokens
from .tokens import count_tokens


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(
        """select -7L as conv_id, to_json(named_struct('messages', array(
             named_struct('role', 'user', 'content', '</s>[INST] ok [/INST]'),
             named_struct('role', 'assistant', 'content', '</s>[INST] ok [/INST]')))) as record"""
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.format_chat(chat.canonical_turns(rows).unionByName(chat.canonical_turns(planted)))
    return chat.read_back(out).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return read_tokens(spark, path)


#: The escaping of the template, as DuckDB writes it.
_ESC = r"""regexp_replace(regexp_replace({}, '(<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g')"""

#: Steps of op3's sequence as rows of place, rule, step and cutoff, and the rules' statistics.
_STEPS = ", ".join(f"({at}, '{rule}', {step}, cast({cut} as double))" for at, rule, step, cut in SEQUENCE)
_VALUES = ", ".join(f"{expr} as {name}" for name, expr in RULES.items())
_LONG = " union all ".join(f"select doc_id, stratum, base_failed, '{name}' as rule, {name} as value from v" for name in RULES)
_SYMBOLS = "#*$%&|<>"
_SPACE = r"[\x20\x09-\x0D]"

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_token_file": op10_token_file,
}

ORACLES = {
    # strings of 50 bytes as 100 hex digits; touching spans are one
    "op1_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        w as materialized (select doc_id, p, substr(h, 2 * p + 1, 100) as g from d, unnest(range(0, greatest(length(h) // 2 - 49, 0))) as u(p)),
        f as (select g, min(doc_id) as m from w group by g having min(doc_id) < max(doc_id)),
        c as (select w.doc_id, w.p from w join f on w.g = f.g where f.m < w.doc_id),
        i as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as k from (
            select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as fresh from c)),
        s as (select doc_id, min(p) as a, max(p) + 50 as z from i group by doc_id, k),
        b as (select s.doc_id, a, z, substr(h, 2 * coalesce(lag(z) over (partition by s.doc_id order by a), 0) + 1,
                2 * (a - coalesce(lag(z) over (partition by s.doc_id order by a), 0))) as before from s join d on s.doc_id = d.doc_id),
        r as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans, max(z) as last, string_agg(before, '' order by a) as kept from b group by doc_id)
        select d.doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
        from d left join r on d.doc_id = r.doc_id""",
    "op2_near_dedup": r"""
        with recursive t as (select doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        d as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from t),
        s as (select doc_id, len(g) as n, unnest(g) as g from d),
        l as (select a.doc_id as u, b.doc_id as v from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
              group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        r as (select doc_id, doc_id as c from d union select r.doc_id, l.v from r join l on r.c = l.u)
        select d.doc_id, len(d.g) as n_shingles, min(c) as component_id, d.doc_id = min(c) as kept from d join r on d.doc_id = r.doc_id group by d.doc_id, d.g""",
    # one row a word, window and line; then the fixed sequence of each stratum, tested with exact binomial tails
    "op3_quality_rules": rf"""
        with t as (select doc_id, coalesce(cast(lang as varchar), '') as stratum, coalesce(text, '') as x from documents),
        s as (select doc_id, stratum, x, list_filter(regexp_split_to_array(x, '{_SPACE}+'), lambda y: y <> '') as w from t),
        g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from s, unnest(range(1, len(w) - 1)) as u(i)),
        r as (select doc_id, count(distinct i + k) as n_repeat_words from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g), (select unnest([0, 1, 2]) as k) where n > 1 group by doc_id),
        l as (select doc_id, count(*) - count(distinct y) as n_dup_lines from (select doc_id, unnest(string_split(x, chr(10))) as y from t) where regexp_matches(y, '[^\x20\x09-\x0D]') group by doc_id),
        b as (select s.doc_id, stratum, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(x, '{_SPACE}', '', 'g')) as bigint) as word_chars,
            cast(length(regexp_replace(x, '[^{_SYMBOLS}]', '', 'g')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
            cast(length(regexp_replace(x, '[^!]', '', 'g')) as bigint) as n_shouts from s left join r on s.doc_id = r.doc_id left join l on s.doc_id = l.doc_id),
        v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {_VALUES} from b),
        step(place, rule, step, cutoff) as (values {_STEPS}),
        a as ({_LONG}),
        f as (select doc_id, stratum, base_failed, a.rule, count(*) filter (value <= cutoff) as first from a join step on a.rule = step.rule group by all),
        q as (select doc_id, min(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id),
        h as (select f.*, quality >= 1 as good from f join q on f.doc_id = q.doc_id where not base_failed),
        p as (select distinct stratum, step.* from h join step on h.rule = step.rule and h.first = step.step where not good),
        j as (select h.doc_id, min(p.place) filter (p.step >= h.first) as joint from h join p on h.stratum = p.stratum and h.rule = p.rule group by h.doc_id),
        e as (select p.stratum, p.place, p.rule, p.step, p.cutoff, count(*) filter (good) as n, count(*) filter (good and coalesce(joint <= p.place, false)) as k,
                count(*) filter (good and first <= p.step) as false_rejected, count(*) filter (not good and first <= p.step) as rejected
              from p join h on p.stratum = h.stratum and p.rule = h.rule join j on h.doc_id = j.doc_id group by all),
        o as (select *, n > 0 and k <= n * 0.01 and ln(list_sum(list_transform(range(0, cast(least(k, floor(n * 0.01)) as bigint) + 1), lambda i:
                exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99))))) <= ln(0.05 / (select count(distinct stratum) from e)) as safe from e),
        c as (select stratum, rule, arg_max(cutoff, (rejected - 10.0 * false_rejected) * 1000 - step) as cutoff from (
                select *, min(case when safe then 1 else 0 end) over (partition by stratum order by place) as ok from o) where ok = 1 and rejected - 10.0 * false_rejected > 0 group by stratum, rule),
        x as (select a.doc_id from a join c on a.stratum = c.stratum and a.rule = c.rule where a.value > c.cutoff group by a.doc_id)
        select v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and (x.doc_id is null or n_words = 0) as kept from v left join x on v.doc_id = x.doc_id""",
    "op4_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    # the schedule slot by slot from whole weights; places inside a source by the MD5 of the ids
    "op6_mixing": f"""
        with recursive d as (select doc_id, coalesce(cast(source as varchar), '') as source, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents),
        c as (select source, count(*) as n, cast(pow(count(*), 0.5) * pow(2, 52) as hugeint) as w, (count(*) + 31) // 32 as blocks from d group by source),
        s as (select list(w order by source) as w, list(blocks order by source) as b, cast(sum(w) as hugeint) as total, cast(sum(blocks) as bigint) as n from c),
        r as (select cast(0 as bigint) as slot, list_transform(b, lambda x: cast(0 as bigint)) as done, cast(null as bigint) as i, cast(null as bigint) as j from s
            union all
            select slot + 1, case when i is null then done else list_transform(done, lambda x, k: x + case when k = i then 1 else 0 end) end, i, done[i] from (
                select slot, done, list_sort(list_transform(list_filter(range(1, len(done) + 1), lambda k: done[k] < b[k] and cast(done[k] as hugeint) * total // w[k] <= slot),
                    lambda k: {{'due': (cast(done[k] + 1 as hugeint) * total + w[k] - 1) // w[k], 'i': k}}))[1].i as i from r, s where list_sum(done) < n)),
        k as (select source, row_number() over (order by source) as i from c),
        a as (select d.*, row_number() over (partition by source order by h % greatest(1, (select count(*) from d) // {BUCKET_ROWS}), h, doc_id) - 1 as rank from d)
        select a.doc_id, a.source, a.rank // 32 as block, r.slot - 1 as slot, (r.slot - 1) * 32 + a.rank % 32 as place
        from a join k on a.source = k.source join r on r.i = k.i and r.j = a.rank // 32""",
    "op5_chat_format": f"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
            union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        g as (
            select conv_id, count(*) as n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
                   coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
                   sum(length(replace(replace({_ESC.format('role')}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'))
                       + length({_ESC.format('text')}) + 24) as formatted_chars
            from t group by conv_id)
        select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars,
               sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
        from g""",
}
