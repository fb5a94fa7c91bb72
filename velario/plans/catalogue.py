"""The registered queries of the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.functions import identifiers as ids
from velario.functions import lexicon as lex
from velario.functions import names
from velario.functions.similarity import indel_ratio, may_be_same_names
from velario.operators import cluster, codenames, detect, doctype, ledger, quality, replace, store
from velario.operators.lineage import cut
from velario.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = fx.for_duckdb(sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# ---- Identifiers ------------------------------------------------------------------------------

EMAIL_RE2 = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"


@query(rf"select doc_id, email from (select doc_id, unnest(regexp_extract_all(text, '{EMAIL_RE2}')) as email from documents) t")
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(ids.find_all(F.col("text"), ids.EMAIL)).alias("email"))


@query(rf"select email, count(*) as n_matches, count(distinct doc_id) as n_docs from (select doc_id, unnest(regexp_extract_all(text, '{EMAIL_RE2}')) as email from documents) t group by email")
def email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return email_extract(spark, sf_dir).groupBy("email").agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"select code, cif, k % 3 < 2 as valid from ({fx.IDS}) i")
def cif_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, fx.IDS).select("code", "cif", ids.valid_cif(F.col("cif")).alias("valid"))


@query(f"select code, nif, k % 2 = 0 as valid from ({fx.IDS}) i")
def nif_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, fx.IDS).select("code", "nif", ids.valid_nif(F.col("nif")).alias("valid"))


@query(f"select code, iban, true as valid, case when k % 4 = 0 then true else cast(substr(iban, 3, 2) as int) in (0, 97) end as valid_damaged from ({fx.IDS}) i")
def iban_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frame(spark, sf_dir, fx.IDS)
    damaged = F.when(F.col("k") % 4 == 0, F.col("iban")).otherwise(F.concat(F.lit("ES00"), F.substring("iban", 5, 20)))
    return rows.select("code", "iban", ids.valid_iban(F.col("iban")).alias("valid"), ids.valid_iban(damaged).alias("valid_damaged"))


@query(f"""
  select id, kind, value from (
    select k as id, 'CIF' as kind, cif as value from ({fx.CLIENTS}) c where k % 4 = 0
    union all select k, 'NIF', nif from ({fx.CLIENTS}) c where k % 4 = 1 and k % 2 = 0
    union all select k, 'IBAN', iban from ({fx.CLIENTS}) c where k % 4 = 2) t""")
def id_keep_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax ids follow a label and stay even with a wrong control; bare ones need it right."""
    found = detect.structured_matches(_notes(spark, sf_dir))
    return found.where("kind in ('CIF', 'NIF', 'IBAN')").select(F.col("doc_id").alias("id"), "kind", "value")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frame(spark, sf_dir, fx.NOTES)
    return rows.select(F.lit("b").alias("batch_id"), F.col("id").alias("doc_id"), F.lit(0).alias("file_ord"), F.lit(0).cast("long").alias("seq"), F.lit("cell").alias("channel"), "code", "name", "text")


@query(f"select code, concat('···', right(cif, 3)) as cif, concat('···', right(nif, 3)) as nif, concat('ES··', right(iban, 4)) as iban, name from ({fx.IDS}) i")
def redact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, fx.IDS).select("code", *[ids.redact_id(F.col(c)).alias(c) for c in ("cif", "nif", "iban", "name")])


# ---- Ledger -----------------------------------------------------------------------------------

_KIND = " ".join(f"when substr(code, 1, 3) in {_list(g)} then '{k}'" for k, g in lex.ACCOUNT_GROUPS.items())
CLASSIFIED = f"select *, case when substr(code, 1, 3) in {_list(lex.PUBLIC_ACCOUNTS)} then null {_KIND} end as kind from ({fx.LEDGER}) l"
_NOTE = r"[,;\s]*[(\[]?\s*(CIF[:\s]*)?[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]\s*[)\]]?"
CLEANED = rf"""
  select row_no, code, kind, description, trim(regexp_replace(case when kind = 'PERSONA' then regexp_replace(t, '^\s*(Anticipo|Préstamo)\s+', '', 'i')
      when kind = 'BANCO' then regexp_replace(t, '\s*-\s*ES\d{{2}}[\d\s]*$', '', 'i') else t end, '^\s*Servicios profesionales\s+', '', 'i')) as name
  from (select *, regexp_replace(regexp_replace(trim(description), '{_NOTE}', '', 'gi'), '^[ ,;-]+|[ ,;-]+$', '', 'g') as t from ({CLASSIFIED}) c) x where kind is not null"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, fx.LEDGER)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_entities(_ledger(spark, sf_dir).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("sheet_ord"), F.col("row_no").alias("row"), "code", "description"))


@query(f"select row_no, code, kind from ({CLASSIFIED}) c")
def account_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).select("row_no", "code", names.classify_account(F.col("code")).alias("kind"))


@query(f"select kind, count(*) as n_rows, count(distinct code) as n_codes from ({CLASSIFIED}) c group by kind")
def account_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account_classify(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("code").alias("n_codes"))


@query(f"select row_no, code, kind, name from ({CLEANED}) c")
def description_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select(F.col("row").alias("row_no"), "code", "kind", "name")


CANDIDATES = f"select name as text, kind, count(*) as count, 'pgc' as source, arg_min(code, row_no) as account_code from ({CLEANED}) c where name <> '' group by name, kind"


@query(CANDIDATES)
def ledger_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_candidates(_entities(spark, sf_dir))


@query(f"select kind, name, description, count(*) as count, row_number() over (partition by kind order by count(*) desc, name, description) as rank from ({CLEANED}) c where name <> '' group by kind, name, description")
def ledger_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.kind_buckets(_entities(spark, sf_dir)).select("kind", "name", "description", "count", "rank")


_LABEL = " ".join(f"when '{k}' then '{v}'" for k, v in lex.ACCOUNT_LABELS.items())


@query(f"select kind, account_code, concat('[', case kind {_LABEL} end, '-', account_code, ']') as codename from ({CANDIDATES}) c")
def codename_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_candidates(spark, sf_dir).select("kind", "account_code", names.account_codename(F.col("kind"), F.col("account_code"), "full").alias("codename"))


@query(f"""select kind, account_code, concat('[', case kind {_LABEL} end, '-', case when length(rest) < 3 then lpad(rest, 3, '0') else rest end, ']') as codename
           from (select *, ltrim(substr(account_code, 4), '0') as rest from ({CANDIDATES}) c) x""")
def codename_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_candidates(spark, sf_dir).select("kind", "account_code", names.account_codename(F.col("kind"), F.col("account_code"), "short").alias("codename"))


def _plain_clusters(candidates: DataFrame) -> DataFrame:
    return candidates.select("kind", F.col("text").alias("canonical"), F.array("text").alias("variants"), F.col("count").alias("total_count"), F.array("account_code").alias("account_codes"))


#: Every seventh candidate by code is known already, under an earlier codename.
KNOWN = f"select 'demo' as project, kind, 0 as kind_ord, upper(text) as original, cast(row_number() over (partition by kind order by text) - 1 as int) as entry_ord, concat('[Antes-', account_code, ']') as codename from ({CANDIDATES}) k where cast(substr(account_code, 4) as int) % 7 = 0"


def _known(candidates: DataFrame) -> DataFrame:
    rows = candidates.where("cast(substr(account_code, 4) as int) % 7 = 0")
    return rows.selectExpr("'demo' as project", "kind", "0 as kind_ord", "upper(text) as original", "cast(row_number() over (partition by kind order by text) - 1 as int) as entry_ord", "concat('[Antes-', account_code, ']') as codename")


#: The first entry of each name in lower case, as existing_codenames takes it.
FIRST_KNOWN = f"select low, codename as known from (select lower(original) as low, codename, row_number() over (partition by lower(original) order by kind_ord, entry_ord, codename) as r from ({KNOWN}) e) x where r = 1"
_PLACEHOLDER = " ".join(f"when '{k}' then concat('[{label}-', case when length(n) < {width} then lpad(n, {width}, '0') else n end, ']')" for k, (label, width) in lex.PLACEHOLDERS.items())


@query(f"""
  with c as (select c.kind, c.text as canonical, c.count as total_count, k.known from ({CANDIDATES}) c left join ({FIRST_KNOWN}) k on k.low = lower(c.text)),
  s as (select kind, count(*) as seed from ({KNOWN}) e group by kind),
  r as (select c.*, cast(coalesce(seed, 0) + row_number() over (partition by c.kind, known is null order by total_count desc, canonical) as varchar) as n from c left join s on s.kind = c.kind)
  select kind, canonical, case when known is not null then known else case kind {_PLACEHOLDER} end end as codename from r""")
def codename_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(ledger_candidates(spark, sf_dir))
    review = codenames.assign_codenames(_plain_clusters(found), cut(_known(found)), "demo", "sequential")
    return review.select("kind", "canonical", "codename")


@query(f"""
  with k as (select lower(original) as low, min(codename) as known, count(distinct codename) as d from ({KNOWN}) x group by 1)
  select c.kind, c.text as canonical, k.known from ({CANDIDATES}) c join k on lower(c.text) = k.low where d = 1""")
def codename_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = cut(ledger_candidates(spark, sf_dir))
    known = cut(_known(candidates))
    once = known.groupBy(F.lower("original").alias("l")).agg(F.count_distinct("codename").alias("d")).where("d = 1")
    found = codenames.existing_codenames(_plain_clusters(candidates), known)
    return found.join(once, F.lower("canonical") == F.col("l"), "left_semi")


# ---- Names ------------------------------------------------------------------------------------

_SUFFIX = "|".join(s.replace(".", r"\.") for s in lex.SOCIETY_SUFFIXES)
_PREFIX = "|".join(lex.ACCOUNTING_PREFIXES)


def _norm_org(column: str) -> str:
    stripped = f"case when regexp_matches({column}, '(?i)^({_PREFIX}) ') then trim(regexp_replace({column}, '^({_PREFIX}) ', '', 'i')) else {column} end"
    return rf"regexp_replace(regexp_replace(regexp_replace(trim(lower({stripped})), '[,;:.]+$', ''), '[ ,]({_SUFFIX})$', ''), '\s+', '', 'g')"


@query(f"select k, variant, {_norm_org('variant')} as norm, {_norm_org('original')} as norm_original from ({fx.VARIANTS}) v")
def normalize_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, fx.VARIANTS).select("k", "variant", names.normalize_org(F.col("variant")).alias("norm"), names.normalize_org(F.col("original")).alias("norm_original"))


@query(r"select p_partkey, regexp_replace(trim(lower(concat(' ', p_name, '  ', p_brand))), '\s+', ' ', 'g') as norm from part")
def normalize_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.normalize_person(F.concat(F.lit(" "), "p_name", F.lit("  "), "p_brand")).alias("norm"))


@query(f"select k, trim(regexp_replace(t, '^({_PREFIX}) ', '', 'i')) as name from (select k, concat(case k % 3 when 0 then 'Ingresos ' when 1 then 'EBITDA ' else 'cliente ' end, original) as t from ({fx.VARIANTS}) v) x")
def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.when(F.col("k") % 3 == 0, "Ingresos ").when(F.col("k") % 3 == 1, "EBITDA ").otherwise("cliente "), "original")
    return fx.frame(spark, sf_dir, fx.VARIANTS).select("k", names.strip_accounting_prefix(t).alias("name"))


#: Texts that the noise filters see: names, references, formulas, cells, stop words.
NOISE = f"""
  select k, case k % 10 when 0 then original when 1 then concat('Factura ', cast(k as string)) when 2 then concat('=A', cast(k as string), '+B2') when 3 then concat('AB', cast(k as string))
    when 4 then concat('FAC-PRE', cast(25 + k as string)) when 5 then 'Saldo' when 6 then concat('SUM(A1:A', cast(k as string), ')') when 7 then 'Hoja!$A$1'
    when 8 then case when k % 20 = 8 then 'Carmen' else '(((' end else concat('12 34', cast(k as string), '678') end as text from ({fx.VARIANTS}) v"""


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, NOISE)


_SHAPES = (r"(?i)^\s*=", r"(?i)\b(SUMIFS|SUMIF|VLOOKUP|HLOOKUP|INDEX|MATCH|IFERROR|SUBSTITUTE|CONCATENATE|ROUND|AVERAGE)\s*\(", r"!\$?[A-Z]+\$?\d*", r"^\$?[A-Z]{1,3}\$?\d+(\s*[+\-*/]\s*\$?[A-Z]{1,3}\$?\d+)*$", r"^[A-Z]{1,3}\d{1,4}$", r"^[+\-*/=\s$()]+$")
_DOCREF = rf"(regexp_extract(lower(trim(text)), '^[^\s]+') in {_list(lex.DOC_PREFIXES)} or regexp_matches(text, '[A-Za-z]{{2,}}[-/][A-Za-z0-9]*\d{{2,}}') or regexp_matches(text, '\d{{5,}}'))"


@query(f"select k, text, {_DOCREF} as is_ref from ({NOISE}) n")
def docref_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise(spark, sf_dir).select("k", "text", names.is_document_ref(F.col("text")).alias("is_ref"))


@query(f"select k, text, length(text) < 2 or {_DOCREF} or " + " or ".join(f"regexp_matches(trim(text), '{s}')" for s in _SHAPES) + f" as is_artefact from ({NOISE}) n")
def artefact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise(spark, sf_dir).select("k", "text", names.is_artefact(F.col("text")).alias("is_artefact"))


@query(rf"""select k, text, trim(text) like '=%' or regexp_matches(text, '(?i)\b(SUM|SUMIF|SUMIFS|IF|TEXT|CONCAT)\s*\(') or regexp_matches(text, '!\$?[A-Z]+') or
  regexp_matches(trim(text), '^\$?[A-Z]{{1,3}}\$?\d+(\s*[+\-*/]\s*\$?[A-Z]{{1,3}}\$?\d+)?$') or abs(length(regexp_replace(text, '[^(]', '', 'g')) - length(regexp_replace(text, '[^)]', '', 'g'))) >= 2 as is_formula from ({NOISE}) n""")
def formula_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise(spark, sf_dir).select("k", "text", names.is_formula_cell(F.col("text")).alias("is_formula"))


@query(f"select k, text, lower(trim(text)) in {_list(lex.GIVEN_NAMES)} as lone_name, lower(text) in {_list(lex.STOPWORDS)} as stopword, regexp_matches(replace(text, ' ', ''), '^\\d+$') as numeric_text from ({NOISE}) n")
def word_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _noise(spark, sf_dir).select("k", "text", names.is_lone_given_name(t).alias("lone_name"), names.is_stopword(t).alias("stopword"), names.is_numeric_text(t).alias("numeric_text"))


# ---- Sheets -----------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, fx.CELLS)


@query(f"""select doc_id, min("row") as header_row, 1 as col_account, 2 as col_desc from ({fx.CELLS}) c where value = 'Subcuenta' group by doc_id""")
def header_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.header_rows(_cells(spark, sf_dir)).select("doc_id", "header_row", "col_account", "col_desc")


@query(f"""select doc_id, "row" as header_row, col, 'CLIENTE' as kind from ({fx.CELLS}) c where value = 'Nombre cliente'""")
def name_header_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.name_columns(_cells(spark, sf_dir)).select("doc_id", "header_row", "col", "kind")


@query(f"""select value as text, 'CLIENTE' as kind, count(distinct doc_id) as count from ({fx.CELLS}) c where col = 2 and "row" > 4 and not regexp_matches(value, '\\d{{5,}}') group by value""")
def named_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.named_column_candidates(_cells(spark, sf_dir)).select("text", "kind", "count")


@query(f"""select doc_id, "row", max(value) filter (col = 1) as code, max(value) filter (col = 2) as description from ({fx.CELLS}) c where "row" > 4 group by doc_id, "row" """)
def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return ledger.ledger_entities(ledger.ledger_rows(cells, ledger.ledger_layout(cells))).select("doc_id", "row", "code", "description")


@query(f"""
  select name_lower, arg_min(case when length(line) <= 120 then line else concat(rtrim(substr(line, 1, 119)), '…') end, doc_id * 1000000 + "row") as snippet from (
    select lower(x.name) as name_lower, r.doc_id, r."row", r.line from (select distinct name from ({fx.CLIENTS}) c) x
    join (select doc_id, "row", string_agg(case when regexp_matches(value, '^B\\d{{7}}[0-9A-J]$') then concat('···', right(value, 3)) else value end, ' · ' order by col) as line from ({fx.CELLS}) c group by doc_id, "row") r
      on contains(lower(r.line), lower(x.name))) h group by name_lower""")
def row_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fx.frame(spark, sf_dir, fx.CLIENTS).select(F.lower("name").alias("name_lower"))
    return ledger.row_contexts(_cells(spark, sf_dir), wanted)


# ---- Similarity and clusters ------------------------------------------------------------------


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, fx.VARIANTS)


_LCS = "list_reduce(list_prepend(list_transform(range(0, length(b) + 1), lambda z: cast(0 as bigint)), list_transform(string_split(a, ''), lambda c: [cast(unicode(c) as bigint)])), lambda r, c: list_reduce(list_prepend([cast(0 as bigint)], list_transform(range(1, length(b) + 1), lambda j: [cast(j as bigint)])), lambda d, j: list_append(d, case when unicode(substr(b, j[1], 1)) = c[1] then r[j[1]] + 1 else greatest(r[j[1] + 1], d[len(d)]) end)))[length(b) + 1]"


@query(f"select k, a, b, round({_LCS} * 200.0 / (length(a) + length(b)), 6) as ratio from (select k, lower(original) as a, lower(variant) as b from ({fx.VARIANTS}) v) x")
def indel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variants(spark, sf_dir).select("k", F.lower("original").alias("a"), F.lower("variant").alias("b"))
    return rows.select("k", "a", "b", F.round(indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


#: Both spellings of each client with their normal forms and ratio; names of different clients are never alike.
PAIRS = f"select *, case when a = b then 100.0 else {_LCS} * 200.0 / (length(a) + length(b)) end as ratio from (select *, {_norm_org('original')} as a, {_norm_org('variant')} as b from ({fx.VARIANTS}) v) x"
_ALIKE = "a <> b and ((least(length(a), length(b)) >= 4 and (starts_with(a, b) or starts_with(b, a))) or (least(length(a), length(b)) >= 6 and ratio >= 82 and ratio < 95))"


@query(f"select k, original, variant from ({PAIRS}) p where {_ALIKE}")
def suggestion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variants(spark, sf_dir)
    return rows.where(may_be_same_names(F.col("original"), F.col("variant"))).select("k", "original", "variant")


def _variant_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variants(spark, sf_dir)
    both = rows.select("kind", F.explode(F.array("original", "variant")).alias("text"), F.concat(F.lit("430"), F.col("k").cast("string")).alias("account_code"))
    return both.groupBy("kind", "text").agg(F.count(F.lit(1)).alias("count"), F.min("account_code").alias("account_code")).withColumn("source", F.lit("pgc"))


_LEAD = "case when length(original) > length(variant) or (length(original) = length(variant) and original < variant) then original else variant end"
_LED = "case when length(original) > length(variant) or (length(original) = length(variant) and original < variant) then variant else original end"
CLUSTERS = f"""
  select kind, {_LEAD} as canonical, [{_LEAD}, {_LED}] as variants, cast(2 as bigint) as total_count, concat('430', k) as code from ({PAIRS}) p where ratio >= 90 and abs(length(a) - length(b)) <= 6
  union all select kind, unnest([original, variant]), [unnest([original, variant])], 1, concat('430', k) from ({PAIRS}) p where ratio < 90 or abs(length(a) - length(b)) > 6"""


@query(f"select kind, canonical, array_to_string(variants, '|') as variants, total_count, code as account_codes from ({CLUSTERS}) c")
def cluster_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.cluster_variants(_variant_candidates(spark, sf_dir))
    return found.select("kind", "canonical", F.array_join("variants", "|").alias("variants"), "total_count", F.array_join("account_codes", "|").alias("account_codes"))


@query(f"""
  with e as (select kind, a, count(*) as n from (select kind, substr(a, 1, 2) as a from ({PAIRS}) p union all select kind, substr(b, 1, 2) from ({PAIRS}) p) x group by kind, a)
  select p.kind, concat(2 * k, ',', 2 * k + 1) as ids from ({PAIRS}) p join e on e.kind = p.kind and e.a = substr(p.a, 1, 2) where {_ALIKE.replace("a <> b", "p.a <> b").replace("length(a)", "length(p.a)").replace("starts_with(a, b)", "starts_with(p.a, b)").replace("starts_with(b, a)", "starts_with(b, p.a)")} and n <= 600""")
def suggestion_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _variants(spark, sf_dir).select((F.col("k") * 2).alias("id"), "kind", F.col("original").alias("name"))
    more = _variants(spark, sf_dir).select((F.col("k") * 2 + 1).alias("id"), "kind", F.col("variant").alias("name"))
    found = cluster.suggestion_groups(entries.unionByName(more))
    return found.select("kind", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"select kind, canonical from (select 'ORG' as kind, original as canonical, k from ({fx.VARIANTS}) v where k % 2 = 1 union all select 'CLIENTE', original, k from ({fx.VARIANTS}) v where k % 2 = 0) t")
def ner_dedup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORG clusters of even keys repeat a ledger name and go; those of odd keys stay."""
    rows = _variants(spark, sf_dir)
    shaped = lambda kind, cond: rows.where(cond).select(F.lit(kind).alias("kind"), F.col("original").alias("canonical"), F.array("original").alias("variants"), F.lit(1).cast("long").alias("total_count"), F.array().cast("array<string>").alias("account_codes"))
    both = shaped("ORG", "true").unionByName(shaped("CLIENTE", "k % 2 = 0"))
    return cluster.drop_covered(both).select("kind", "canonical")


# ---- Mapping, replacement, verification -------------------------------------------------------

#: Clients and suppliers with full codenames; entries in order of the code.
MAPPING = f"select 'demo' as project, case when code like '430%' then 'CLIENTE' else 'PROVEEDOR' end as kind, case when code like '430%' then 8 else 9 end as kind_ord, name as original, cast(k as int) as entry_ord, concat(case when code like '430%' then '[Cliente-' else '[Proveedor-' end, code, ']') as codename from ({fx.IDS}) i"


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, MAPPING)


@query(f"select original, arg_max(codename, kind_ord * 10000000 + entry_ord) as codename from ({MAPPING}) m group by original")
def mapping_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.flatten(_mapping(spark, sf_dir))


@query(f"select codename as original, arg_max(original, length(original) * 10000000 - entry_ord) as codename from (select original, entry_ord, replace(codename, right(codename, 2), ']') as codename from ({MAPPING}) m where length(original) > 0) x group by codename")
def mapping_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codenames lose their last digit, so ten entries share one: the longest original stands, the first of equals."""
    rows = _mapping(spark, sf_dir).withColumn("codename", F.expr("replace(codename, right(codename, 2), ']')"))
    return replace.invert_mapping(rows)


@query(f"select project, count(*) as entries, count(distinct kind) as kinds from ({MAPPING}) m group by project")
def mapping_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.project_totals(_mapping(spark, sf_dir))


REPLACED = f"select id, replace(text, name, concat('[Cliente-', code, ']')) as text, 1 as n_replaced from ({fx.NOTES}) n"


@query(f"select id, text as replaced, n_replaced from ({REPLACED}) r")
def replace_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frame(spark, sf_dir, fx.NOTES).select("id", "text")
    return replace.replace_names(rows, _mapping(spark, sf_dir)).select("id", "replaced", "n_replaced")


@query(f"select id, text as replaced, n_replaced from ({REPLACED}) r")
def replace_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for mappings that no task could hold."""
    rows = fx.frame(spark, sf_dir, fx.NOTES).select("id", "text")
    return replace.replace_names(rows, _mapping(spark, sf_dir), form="join").select("id", "replaced", "n_replaced")


@query(f"select code, name as original from ({fx.NOTES}) n where id % 5 = 0")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the notes keep their names: exactly those survive."""
    rows = fx.frame(spark, sf_dir, fx.NOTES)
    text = F.when(F.col("id") % 5 == 0, F.lower("text")).otherwise(F.replace("text", F.col("name"), F.lit("[X]")))
    return replace.find_surviving(rows.select("code", text.alias("text")), _mapping(spark, sf_dir), ("code",))


@query(f"select id as doc_id, case when id % 5 = 0 and id % 7 <> 1 then name else '' end as surviving, id % 7 <> 1 as verifiable, id % 7 <> 1 and id % 5 <> 0 as is_clean from ({fx.NOTES}) n")
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document comes out empty from a large source: no surviving name, not verifiable, so not clean."""
    rows = fx.frame(spark, sf_dir, fx.NOTES)
    sources = rows.select(F.col("id").alias("doc_id"), F.lit(20_000).alias("length"))
    text = F.when(F.col("id") % 7 == 1, F.lit("")).when(F.col("id") % 5 == 0, F.col("text")).otherwise(F.replace("text", F.col("name"), F.lit("[X]")))
    out = replace.verify_report(sources, rows.select(F.col("id").alias("doc_id"), text.alias("text")), _mapping(spark, sf_dir))
    return out.select("doc_id", F.array_join("surviving", ",").alias("surviving"), "verifiable", "is_clean")


@query(f"select id, text from ({fx.NOTES}) n")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frame(spark, sf_dir, fx.NOTES).select("id", "text")
    mapping = _mapping(spark, sf_dir)
    coded = replace.replace_names(rows, mapping).select("id", F.col("replaced").alias("coded"))
    return replace.rehydrate(coded, mapping, "coded").select("id", F.col("restored").alias("text"))


@query(f"""select conv_id, turn, concat(c.name, ' dice: ', coalesce(t.text, '')) as restored from conversations t join ({fx.CLIENTS}) c on c.k = t.conv_id % 100""")
def conversation_rehydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    code = F.concat(F.lit("[Cliente-430"), F.lpad((F.col("conv_id") % 100).cast("string"), 7, "0"), F.lit("] dice: "))
    coded = turns.select("conv_id", "turn", F.concat(code, F.coalesce("text", F.lit(""))).alias("text"))
    return replace.rehydrate(coded, _mapping(spark, sf_dir)).select("conv_id", "turn", "restored")


# ---- Document types, audit, quality -----------------------------------------------------------


def _hits(words) -> str:
    return " + ".join(f"cast(contains(low, '{w}') as int)" for w in words)


DOC_SCORES = f"select doc_id, source, {_hits(lex.LEGAL_KEYWORDS)} as legal, {_hits(lex.TEASER_KEYWORDS)} as teaser from (select doc_id, source, lower(concat(text, case doc_id % 4 when 0 then ' Comprador y vendedor, ambas partes' when 1 then ' Executive Summary and disclaimer' else '' end)) as low from documents) d"
DOC_TYPES = f"select doc_id, source, case when legal >= 2 and legal > teaser then 'legal' when teaser >= 2 then 'teaser_im' else 'generic' end as doctype, case when legal >= 2 and legal > teaser then least(1.0, 0.5 + 0.1 * legal) when teaser >= 2 then least(1.0, 0.5 + 0.1 * teaser) else 0.3 end as confidence from ({DOC_SCORES}) s"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = F.when(F.col("doc_id") % 4 == 0, " Comprador y vendedor, ambas partes").when(F.col("doc_id") % 4 == 1, " Executive Summary and disclaimer").otherwise("")
    found = doctype.document_keywords(docs.select("doc_id", F.concat("text", more).alias("text")))
    full = found.select("doc_id", F.lit("docx").alias("suffix"), F.lit(0).alias("n_entities"), F.lit(0).alias("n_sheets"), "legal", "teaser", F.lit(True).alias("readable"))
    return doctype.guess_doctype(full).join(docs.select("doc_id", "source"), "doc_id")


@query(f"select doc_id, doctype, cast(round(confidence, 6) as double) as confidence from ({DOC_TYPES}) t")
def doctype_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("doc_id", "doctype", F.round("confidence", 6).alias("confidence"))


@query(f"""
  with p as (select source, doctype, count(*) as n from ({DOC_TYPES}) t group by source, doctype),
  v as (select source, sum(n) as files, count(*) as types, max(n) as top from p group by source)
  select v.source, cast(v.files as bigint) as files, case when types = 1 or top / files >= 0.7 then (select max(doctype) from p where p.source = v.source and p.n = v.top) else 'datapack' end as doctype from v""")
def doctype_batch_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doctype.batch_vote(_typed(spark, sf_dir), ("source",)).select("source", "files", "doctype")


@query("select event_type as project, 'run' as action, count(*) as events, cast(sum(user_id % 10) as bigint) as files, cast(sum(user_id % 100) as bigint) as entities, cast(sum(case when value > 50 then 1 else 0 end) as bigint) as leaks, cast(0 as bigint) as unverifiable from events group by event_type")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("project"), "ts", F.lit("run").alias("action"), (F.col("user_id") % 10).alias("files"), (F.col("user_id") % 100).alias("entities"), F.when(F.col("value") > 50, 1).otherwise(0).cast("long").alias("leaks"), F.lit(None).cast("long").alias("unverifiable"))
    return store.audit_totals(rows)


@query("select event_type as project, event_id as version from (select *, row_number() over (partition by event_type order by event_id desc) as r from events) e where r <= 20")
def backup_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_newest(table(spark, sf_dir, "events").select(F.col("event_type").alias("project"), F.col("event_id").alias("version"))).select("project", "version")


@query(f"select id as doc_id, cast(1 as bigint) as truth, cast(case when id % 3 = 2 then 0 else 1 end as bigint) as hits, cast(case when id % 3 = 2 then 1 else 0 end as bigint) as missed, cast(case when id % 3 = 1 then 1 else 0 end as bigint) as false_positives, cast(case when id % 3 = 2 then 0 else 100 end as double) as coverage from ({fx.NOTES}) n")
def detector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of key 0 mod 3 are found, of 1 found beside a false one, of 2 missed."""
    rows = fx.frame(spark, sf_dir, fx.NOTES).select(F.col("id").alias("doc_id"), "name")
    found = rows.where("doc_id % 3 < 2").select("doc_id", F.col("name").alias("text")).unionByName(rows.where("doc_id % 3 = 1").select("doc_id", F.lit("0000").alias("text")))
    out = quality.detector_quality(rows, found)
    return out.select("doc_id", "truth", "hits", "missed", "false_positives", F.col("coverage").cast("double").alias("coverage"))




def _consuming(shape: str) -> str:
    """A detection shape for DuckDB: ASCII classes, the end that Spark only looks at is read too; the name is group 1."""
    head, end = shape.replace("(?U)", "").split("(?=")
    return ("(" + head + ")(?:" + end).replace("'", "''")


_IS_ARTEFACT = f"(length(text) < 2 or {_DOCREF} or " + " or ".join(f"regexp_matches(trim(text), '{x}')" for x in _SHAPES) + ")"
_CUT = "rtrim(regexp_replace(trim({}), ',+$', ''))"
ORGS = f"""
  select text, count(*) as count from (
    select text from (select {_CUT.format("f")} as text, trim(p) as part from (select unnest(regexp_extract_all(text, '{_consuming(detect.ORG_SHAPE)}', 1)) as f, unnest(regexp_extract_all(text, '{_consuming(detect.ORG_SHAPE)}', 2)) as p from (select distinct text from ({fx.NOTES}) n) t) m) x
      where lower(part) not in {_list(lex.STOPWORDS)} and not {_IS_ARTEFACT}
    union all select text from (select trim(unnest(regexp_extract_all(text, '{detect.UPPER_SHAPE.replace("(?U)", "")}', 1))) as text from (select distinct text from ({fx.NOTES}) n) t) y
      where lower(text) not in {_list(lex.STOPWORDS)} and len(list_filter(string_split(text, ' '), lambda w: lower(w) not in {_list(lex.STOPWORDS)})) > 0 and not {_IS_ARTEFACT}) z group by text"""


@query(ORGS)
def heuristic_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.heuristic_orgs(_notes(spark, sf_dir))


_SEGMENT = "concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)))"


@query(f"""
  select text, count(*) as count from (select distinct c_mktsegment, unnest(case when lower(c_mktsegment) in {_list(lex.STOPWORDS)} then ['Luis Customer'] else [concat('Carmen ', {_SEGMENT}), 'Luis Customer'] end) as text from customer) t group by text""")
def heuristic_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.lit("b").alias("batch_id"), F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Firma Carmen "), F.initcap("c_mktsegment"), F.lit(" y Luis "), F.initcap(F.regexp_replace("c_name", "[^A-Za-z]", "")), F.lit(" hoy")).alias("text"))
    return detect.heuristic_persons(rows)


_SUBSTRINGS = "cast(sum((length(t.text) - length(replace(t.text, v.text, ''))) / length(v.text)) as bigint)"


@query(f"""
  with o as materialized ({ORGS}), t as materialized (select distinct text from ({fx.NOTES}) n),
  f as (select distinct {_CUT.format("m")} as text from (select o.text as org, unnest(regexp_extract_all(t.text, concat('(?i)(', regexp_escape(o.text), '{_consuming(detect.SUFFIX_SHAPE)[1:]}'), 1)) as m from o join t on contains(lower(t.text), lower(o.text))) x where {_CUT.format("m")} <> org),
  v as (select f.text from f anti join o on o.text = f.text),
  i as (select distinct kind, value from (select 'CIF' as kind, cif as value from ({fx.CLIENTS}) c where k % 4 = 0 union all select 'IBAN', iban from ({fx.CLIENTS}) c where k % 4 = 2
        union all select 'EMAIL', unnest(regexp_extract_all(text, '{EMAIL_RE2}')) from t) y)
  select text, 'ORG' as kind, count, 'ner' as source, cast(null as varchar) as account_code from o
  union all select v.text, 'ORG', {_SUBSTRINGS}, 'ner', null from v join t on contains(t.text, v.text) group by v.text
  union all select v.text, v.kind, {_SUBSTRINGS}, 'regex', null from (select kind, value as text from i) v join t on contains(t.text, v.text) group by v.text, v.kind""")
def detect_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_candidates(cut(_notes(spark, sf_dir).withColumn("before", F.lit(""))))


_TYPE = " ".join(f"when '{k}' then '{v}'" for k, v in lex.KIND_TO_TYPE.items())


@query(f"""
  with c as (select *, row_number() over () as i from ({CLUSTERS}) x),
  h as (select i, arg_min(known, pos) as known from (select i, unnest(variants) as v, unnest(range(len(variants))) as pos from c) y join ({FIRST_KNOWN}) k on k.low = lower(v) group by i),
  r as (select kind, canonical, code as accounts, total_count, coalesce(known, concat('[Cliente-', code, ']')) as codename from c left join h using (i) union all select 'ORG', 'Global Menta', '—', 0, 'Demo')
  select cast(row_number() over (order by total_count desc, canonical, kind) - 1 as int) as row_id, case kind {_TYPE} end as type, kind, canonical, accounts, total_count, codename from r""")
def assign_codenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = cut(cluster.cluster_variants(_variant_candidates(spark, sf_dir)))
    review = codenames.assign_codenames(clusters, cut(_known(ledger_candidates(spark, sf_dir))), "demo", "account_full", "Global Menta")
    return review.select("row_id", "type", "kind", "canonical", "accounts", "total_count", "codename")


# ---- Odd shapes, edits and versions --------------------------------------------------------------

#: Identifiers in capitals and not, with blanks, cut short, too long, empty and null.
MESSY = f"""
  select code, k, case k % 7 when 1 then lower(cif) when 2 then concat('  ', cif, ' ') when 3 then substr(cif, 1, 8) when 4 then null when 5 then concat(cif, '0') when 6 then '' else cif end as cif,
    case k % 7 when 1 then lower(nif) when 2 then concat('  ', nif, ' ') when 3 then substr(nif, 2) when 4 then null when 5 then concat('X', substr(nif, 2)) when 6 then '' else nif end as nif,
    case k % 7 when 1 then lower(iban) when 2 then concat(substr(iban, 1, 4), ' ', substr(iban, 5, 4), '-', substr(iban, 9)) when 3 then substr(iban, 1, 23) when 4 then null when 5 then concat('DE', substr(iban, 3)) when 6 then '' else iban end as iban
  from ({fx.IDS}) i"""
_DOUBLED = " + ".join(f"case when cast(substr(c, {i}, 1) as int) > 4 then 2 * cast(substr(c, {i}, 1) as int) - 9 else 2 * cast(substr(c, {i}, 1) as int) end" if i % 2 == 0 else f"cast(substr(c, {i}, 1) as int)" for i in range(2, 9))


@query(f"""
  with u as (select *, upper(trim(cif)) as c, upper(trim(nif)) as n, replace(replace(upper(trim(iban)), ' ', ''), '-', '') as b from ({MESSY}) m),
  w as (select *, case when regexp_matches(c, '^[ABCDEFGHJKLMNPQRSUVW][0-9]{{7}}[0-9A-J]$') then (10 - ({_DOUBLED}) % 10) % 10 end as d,
        case when regexp_matches(n, '^([XYZ][0-9]{{7}}|[0-9]{{8}})[A-Z]$') then cast(translate(substr(n, 1, 8), 'XYZ', '012') as int) % 23 end as l, case when regexp_matches(b, '^ES[0-9]{{22}}$') then cast(concat(substr(b, 5), '1428', substr(b, 3, 2)) as hugeint) % 97 end as m from u)
  select code, coalesce(right(c, 1) in (cast(d as varchar), substr('JABCDEFGHI', cast(d + 1 as int), 1)), false) as cif, coalesce(right(n, 1) = substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(l + 1 as int), 1), false) as nif, coalesce(m = 1, false) as iban from w""")
def messy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frame(spark, sf_dir, MESSY)
    return rows.select("code", ids.valid_cif(F.col("cif")).alias("cif"), ids.valid_nif(F.col("nif")).alias("nif"), ids.valid_iban(F.col("iban")).alias("iban"))


#: Addresses and phones as people write them, beside what only looks like one.
CONTACTS = f"""
  select k, concat(case k % 6 when 0 then 'Vive en Calle Mayor ' when 1 then 'Sede: Avda. Del Puerto, ' when 2 then 'Plaza Nueva ' when 3 then 'calle mayor ' when 4 then 'Ctra. Vieja de Olot ' else 'Paseo ' end, cast(k % 300 as string),
    case k % 4 when 0 then 'B, Madrid Centro' when 1 then '' when 2 then ' bajo' else ', Lleida' end, '. Tel ',
    case k % 5 when 0 then '+34 ' when 1 then '34-' when 2 then '0' else '' end, case k % 7 when 0 then '6' when 1 then '71' when 2 then '9' when 3 then '8' when 4 then '5' when 5 then '70' else '7' end,
    lpad(cast((k * 7919) % 100000000 as string), 8, '0'), case k % 3 when 0 then ' hoy' when 1 then '.' else '-x' end) as text from ({fx.CLIENTS}) c"""


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"select k, unnest(regexp_extract_all(text, '{_re2(ids.ADDRESS)}')) as address from ({CONTACTS}) c")
def address_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, CONTACTS).select("k", F.explode(ids.find_all(F.col("text"), ids.ADDRESS)).alias("address"))


@query(f"select k, unnest(regexp_extract_all(text, '{_re2(ids.PHONE)}')) as phone from ({CONTACTS}) c")
def phone_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, CONTACTS).select("k", F.explode(ids.find_all(F.col("text"), ids.PHONE)).alias("phone"))


#: Fragments of three files in turn: labels, names, nulls and empty texts.
SHEETS = f"select cast((k - 1) % 3 as int) as file_ord, cast(9 - (k - 1) % 3 as bigint) as doc_id, cast(floor((k - 1) / 3) as bigint) as seq, case k % 5 when 0 then null when 1 then 'CIF:' when 2 then '' else name end as text from ({fx.CLIENTS}) c"


@query(f"""
  select file_ord, seq, regexp_replace(right(coalesce(ahead, ''), 14), '^\\n+', '') as before from (
    select file_ord, seq, string_agg(concat(right(coalesce(text, ''), 14), chr(10)), '') over (order by file_ord, seq rows between 14 preceding and 1 preceding) as ahead from ({SHEETS}) s) x""")
def previous_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands ahead of a fragment, across the borders of fragments and files."""
    rows = cut(fx.frame(spark, sf_dir, SHEETS).withColumn("batch_id", F.lit("b")))
    return detect.with_previous_text(rows).select("file_ord", "seq", F.regexp_replace("before", "^\n+", "").alias("before"))


@query(r"select p_partkey, regexp_replace(concat(p_name, ' *', p_brand, '_'), '([\\`*_{}\[\]()#+\-.!|>~$])', '\\\1', 'g') as escaped, regexp_matches(replace(p_name, ' ', case when p_partkey % 2 = 0 then '_' else '.' end), '^[a-z0-9_-]+$') as is_name from part")
def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "_").otherwise("."))
    return table(spark, sf_dir, "part").select("p_partkey", names.escape_markdown(F.concat("p_name", F.lit(" *"), "p_brand", F.lit("_"))).alias("escaped"), names.is_project_name(name).alias("is_name"))


@query(f"""
  with r as (select k as row_id, name, case when k % 3 = 0 then 'BANCO' else 'PROVEEDOR' end as kind, case when k % 5 = 0 then concat('[X-', k, ']') else concat('[P-', k, ']') end as codename from ({fx.SUPPLIERS}) s where k % 7 <> 0)
  select 'demo' as project, kind, case kind when 'BANCO' then {list(lex.KIND_LABELS).index("BANCO")} else {list(lex.KIND_LABELS).index("PROVEEDOR")} end as kind_ord, original, cast(row_number() over (partition by kind order by row_id, pos) - 1 as int) as entry_ord, codename
  from (select row_id, kind, codename, unnest([name, lower(name)]) as original, unnest([0, 1]) as pos from r) x""")
def review_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, codenames and marks changed in the review table, then the mapping of the marked rows."""
    rows = fx.frame(spark, sf_dir, fx.SUPPLIERS)
    review = rows.select(F.col("k").alias("row_id"), F.lit(True).alias("anonymise"), F.lit("Proveedor").alias("type"), F.lit("PROVEEDOR").alias("kind"), F.array("name", F.lower("name")).alias("variants"), F.concat(F.lit("[P-"), "k", F.lit("]")).alias("codename"))
    edits = rows.select(F.col("k").alias("row_id"), F.when(F.col("k") % 7 == 0, False).alias("anonymise"), F.when(F.col("k") % 3 == 0, "Banco").alias("type"), F.when(F.col("k") % 5 == 0, F.concat(F.lit("[X-"), "k", F.lit("]"))).alias("codename"))
    return codenames.review_to_mapping(codenames.apply_edits(review, edits), "demo")


_OLD = f"select 'demo' as project, 'ORG' as kind, 0 as kind_ord, name as original, cast(k as int) as entry_ord, concat('[A-', k, ']') as codename from ({fx.SUPPLIERS}) s where k % 3 <> 0"
_NEW = f"select 'demo' as project, 'ORG' as kind, 0 as kind_ord, name as original, cast(k as int) as entry_ord, concat('[B-', k, ']') as codename from ({fx.SUPPLIERS}) s where k % 2 = 0"


@query(f"""
  with o as ({_OLD}), n as ({_NEW}), a as (select n.* from n anti join o on o.original = n.original)
  select o.project, o.kind, o.kind_ord, o.original, o.entry_ord, coalesce(n.codename, o.codename) as codename from o left join n on n.original = o.original
  union all select project, kind, kind_ord, original, cast((select max(entry_ord) + 1 from o) + row_number() over (order by entry_ord, original) - 1 as int), codename from a""")
def mapping_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New codenames take the place of old ones, new names follow after all entries."""
    return store.upsert(fx.frame(spark, sf_dir, _OLD), fx.frame(spark, sf_dir, _NEW))


# ---- Flagship ---------------------------------------------------------------------------------


@query(f"select kind, count(*) as n_entities, cast(count(*) as bigint) as n_replaced, cast(0 as bigint) as n_surviving from ({CLEANED}) c where kind in ('CLIENTE', 'PROVEEDOR') group by kind")
def ledger_pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger to counterparties, codenames, rewritten descriptions and a leak count by kind."""
    entities = _entities(spark, sf_dir).where("kind in ('CLIENTE', 'PROVEEDOR')")
    names_ = ledger.ledger_candidates(entities).withColumn("codename", names.account_codename(F.col("kind"), F.col("account_code"), "full"))
    mapping = names_.select(F.col("text").alias("original"), "codename")
    mapping = cut(mapping)
    done = cut(replace.replace_names(entities.select("row", "kind", F.col("description").alias("text")), mapping))
    left = replace.find_surviving(done.select("row", F.col("replaced").alias("text")), mapping, ("row",)).groupBy("row").agg(F.count(F.lit(1)).alias("left"))
    joined = done.join(left, "row", "left")
    return joined.groupBy("kind").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n_replaced").alias("n_replaced"), F.coalesce(F.sum("left"), F.lit(0)).alias("n_surviving"))
