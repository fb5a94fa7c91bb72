"""One query for each training-data operator, over whole tables, and DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.llm import chat, decontam, exact_dedup, lang_id, mixing, near_dedup, pii, secrets, substring_dedup, token_count
from velario.llm.common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = lang_id.train(docs)
    marked = docs.select("doc_id", "text")
    found = lang_id.predict(marked, model)
    return found.select("doc_id", lang_id.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


#: The conversation that the contract adds: both turns hold the template's own control strings.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    made = chat.format_conversations(chat.with_text_parts(told.unionByName(extra)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            rows = [chat.digest_formatted(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return made.select("conv_id", "formatted", "loss_spans").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed parts behind the texts: an image, a recording or a paper by turn; attachments are read back."""
    told = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    name = F.concat_ws("-", "conv_id", "turn")
    size = F.col("conv_id") % 2000
    image = chat.reference_part("image", F.concat(F.lit("image-"), name), width=size, height=F.col("turn") * 300)
    audio = chat.reference_part("audio", F.concat(F.lit("audio-"), name), seconds=size / 8)
    paper = chat.reference_part("document", F.concat(F.lit("document-"), name), pages=size % 9)
    text = chat.text_part(F.col("text"))
    parts = F.when(F.col("turn") % 4 == 0, F.array(text, image)).when(F.col("turn") % 4 == 1, F.array(audio, text, paper)).otherwise(F.array(text))
    made = chat.format_conversations(told.withColumn("parts", parts))
    shown = F.regexp_extract_all("formatted", F.lit(r"<\|((?:image|audio|document):[0-9]+)\|>"), F.lit(1))
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    refs = F.array_join(F.transform("attachments", lambda a: F.concat_ws("=", "conv_id", a["ref"], a["tokens"])), ",")
    return made.select("conv_id", F.size("attachments").cast("long").alias("n_attachments"), tokens.alias("tokens"), refs.alias("refs"), F.array_join(shown, ",").alias("placeholders"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda name: name == kind


def _reported(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in base]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(_joined(own), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(pii.pii_spans(documents(spark, sf_dir)), pii.BASE_KINDS)


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of op4 alone, which SQL can express."""
    return op4_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.BASE_KINDS], "base_sha256")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of op7: size, target, and whether the words taken come near it."""
    docs = documents(spark, sf_dir).select("doc_id", "source")
    rows = op7_mixing(spark, sf_dir).join(docs, "doc_id")
    by_source = rows.groupBy("source").agg(F.first("source_size").alias("source_size"), F.round(F.first("target"), 2).alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("largest"))
    near = F.abs(F.col("taken") - F.col("target")) <= F.col("target") / 100 + F.col("largest") / 2
    return by_source.select("source", "source_size", "target", near.alias("near"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontam.find_leaks(documents(spark, sf_dir).select("doc_id", "text"), items)
    ids = F.array_join(F.array_sort(F.transform("hits", lambda h: h["item_id"])), ",")
    return found.select("doc_id", F.size("hits").cast("long").alias("n_items"), ids.alias("item_ids"), (F.size("hits") > 0).alias("contaminated"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(secrets.secret_spans(documents(spark, sf_dir)), secrets.BASE_KINDS)


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of op10 alone, which SQL can express."""
    return op10_secrets(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in secrets.BASE_KINDS], "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_chat_format, chat_typed_parts, op3_substring_dedup, op4_pii, pii_base, op5_near_dedup, op6_token_count,
        op7_mixing, mixing_targets, op8_exact_dedup, op9_decontamination, op10_secrets, secrets_base,
    )
}

#: Attachments of chat_typed_parts in the order of their turns, from the tables alone.
_ATTACHED = """
  select conv_id, turn, 0 as k, 'image' as kind, (greatest(1, cast(ceil(greatest(conv_id % 2000, 1) / 512.0) as bigint)) * cast(ceil(greatest(turn * 300, 1) / 512.0) as bigint)) * 170 as n
    from conversations where turn % 4 = 0
  union all select conv_id, turn, 0, 'audio', cast(ceil(greatest(conv_id % 2000, 0) / 8.0 * 25) as bigint) from conversations where turn % 4 = 1
  union all select conv_id, turn, 1, 'document', greatest(conv_id % 2000 % 9, 1) * 600 from conversations where turn % 4 = 1"""


def _spans_sql(patterns: dict[str, str], valid: dict[str, str], order: str) -> str:
    """Counts and digest of the base kinds: a match begins where the gaps and matches before it end."""
    kinds = list(patterns)
    found = " union all ".join(
        f"select doc_id, {k} as k, '{kind}' as kind, regexp_extract_all(text, {p}) as ms, regexp_extract_all(text, {p}, {2 if kind == 'assign' else 0}) as vs, string_split_regex(text, {p}) as gs from t" for k, (kind, p) in enumerate(patterns.items())
    )
    counts = ", ".join(f"count(*) filter (kind = '{kind}') as n_{kind}" for kind in kinds)
    rules = " ".join(f"when '{kind}' then {rule}" for kind, rule in valid.items())
    return f"""
        with t as (select doc_id, coalesce(text, '') as text from documents),
        m as ({found}),
        s as (select *, unnest(range(1, len(ms) + 1)) as i from m where len(ms) > 0),
        p as (select doc_id, k, kind, ms[i] as v, vs[i] as v2, regexp_replace(ms[i], '[^0-9]', '', 'g') as d,
              cast(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as bigint) as a from s),
        o as (select * from p where case kind {rules} end),
        g as (select doc_id, {counts}, string_agg(concat(kind, ':', a, ':', a + length(v)), ',' order by {order}) as spans from o group by doc_id)
        select t.doc_id, {", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind in kinds)}, sha256(coalesce(spans, '')) as base_sha256 from t left join g using (doc_id)"""


_LUHN = "list_sum(list_transform(range(0, length(d)), lambda i: case when i % 2 = 0 then cast(d[length(d) - i] as int) else 2 * cast(d[length(d) - i] as int) - case when cast(d[length(d) - i] as int) > 4 then 9 else 0 end end)) % 10 = 0"

ORACLES: dict[str, str] = {
    "pii_base": _spans_sql(
        {
            "email": r"'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'",
            "ip": r"'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'",
            "card": r"'[0-9]([\x20-]?[0-9])+'",
            "phone": r"'\+[0-9][\x20().0-9-]+[0-9]'",
        },
        {"email": "true", "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(x as bigint), 0) > 255)) = 0", "card": f"length(d) between 16 and 19 and {_LUHN}", "phone": "length(d) between 8 and 15"},
        "k, a",
    ),
    "secrets_base": _spans_sql(
        {
            "assign": r"""'((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""",
            "access": "'AKIA[A-Z0-9]+'",
            "hex": "'[0-9a-f]+'",
        },
        {"assign": "length(v2) >= 6", "access": "length(v) >= 20", "hex": "length(v) >= 24"},
        "a, k",
    ),
    "mixing_targets": r"""
        with s as (select source, cast(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) as bigint) as size from documents group by source),
        a as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, 2 * size as cap, 1.5 * sum(size) over () as total from s),
        b as (select *, (total - coalesce(sum(cap) over (order by cap / w, source rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, source rows between current row and unbounded following) as level from a),
        f as (select min(cap / w) as ratio, arg_min(level, cap / w) as level from b where level * w <= cap)
        select source, size as source_size, round(cast(least(cap, f.level * w) as double), 2) as target, true as near from b cross join f""",
    "chat_typed_parts": f"""
        with a as (select *, row_number() over (partition by conv_id order by turn, k) - 1 as i from ({_ATTACHED}) x),
        g as (select conv_id, count(*) as n_attachments, cast(sum(n) as bigint) as tokens,
              string_agg(concat(conv_id, '=', kind, '-', conv_id, '-', turn, '=', n), ',' order by i) as refs, string_agg(concat(kind, ':', i), ',' order by i) as placeholders from a group by conv_id)
        select c.conv_id, coalesce(n_attachments, 0) as n_attachments, coalesce(tokens, 0) as tokens, coalesce(refs, '') as refs, coalesce(placeholders, '') as placeholders
        from (select distinct conv_id from conversations) c left join g using (conv_id)""",
    "op2_chat_format": rf"""
        with c as (select conv_id, turn, role, text from conversations union all select -1, 0, 'user', '{CONTROL_TEXT}' union all select -1, 1, 'assistant', '{CONTROL_TEXT}'),
        t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
        e as (select *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as body, replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n') as head from t)
        select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               cast(sum(24 + length(head) + length(body)) as bigint) as formatted_chars
        from e group by conv_id""",
    "op3_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        v as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as x from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w) u),
        d as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by x) as least from v) m where least < doc_id),
        g as (select distinct doc_id, i + k as j from d cross join (select unnest(range(0, 50)) as k) r),
        p as (select doc_id, ws[j] as word, j from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as j from w) u),
        k as (select p.doc_id, count(*) as n_kept, string_agg(word, ' ' order by p.j) as kept from p left join g on p.doc_id = g.doc_id and p.j = g.j where g.j is null group by p.doc_id)
        select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n_kept, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k on w.doc_id = k.doc_id""",
    "op5_near_dedup": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
        s as (select distinct doc_id, hash(array_to_string(ws[i:i + 4], ' ')) as x from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0) u),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
        e as (select a, b from l union all select b, a from l),
        r(x, y) as (select a, b from e union select r.x, e.b from r join e on r.y = e.a),
        m as (select x, min(y) as least from r group by x)
        select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) as component_id, w.doc_id <= coalesce(m.least, w.doc_id) as kept
        from w left join n on n.doc_id = w.doc_id left join m on m.x = w.doc_id""",
    "op8_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t""",
}
