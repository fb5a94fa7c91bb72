"""Codenames: earlier mapping, main company, account code, then running placeholders.

mapping: (project, kind, kind_ord, original, entry_ord, codename). Numbering is a window over the
clusters of one kind that still need a number; a project's clusters are names for review, far
fewer than rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velario.functions import lexicon as lex
from velario.functions import names
from velario.operators.cluster import suggestion_groups
from velario.operators.lineage import sorted_side

MODES = ("account_full", "account_short", "sequential")
MAPPING = "project string, kind string, kind_ord int, original string, entry_ord int, codename string"


def existing_codenames(clusters: DataFrame, mapping: DataFrame) -> DataFrame:
    """(kind, canonical, codename): the first entry equal in any case to the first variant that has one."""
    keyed = clusters.select("kind", "canonical", F.posexplode("variants").alias("pos", "variant")).withColumn("low", F.lower("variant"))
    entries = mapping.select(F.lower("original").alias("low"), F.col("codename").alias("known"), "kind_ord", "entry_ord")
    first = entries.groupBy("low").agg(F.min_by("known", F.struct("kind_ord", "entry_ord", "known")).alias("known"))
    hits = keyed.join(sorted_side(first), "low")
    return hits.groupBy("kind", "canonical").agg(F.min_by("known", "pos").alias("known"))


def _is_main(main_company: str) -> Column:
    main = main_company.strip().lower()
    if not main:
        return F.lit(False)
    return F.exists(F.concat(F.array("canonical"), "variants"), lambda v: F.contains(F.lower(v), F.lit(main)) | F.contains(F.lit(main), F.lower(v)))


def assign_codenames(clusters: DataFrame, mapping: DataFrame | None, project: str, mode: str = "account_full", main_company: str = "") -> DataFrame:
    """The review table: kind, canonical, variants, account_codes, total_count, codename, row_id, anonymise, type."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = clusters.sparkSession
    mapping = spark.createDataFrame([], MAPPING) if mapping is None else mapping.where(F.col("project") == project)
    codename = project.capitalize()
    rows = merge_same_names(clusters)
    rows = rows.join(sorted_side(existing_codenames(rows, mapping)), ["kind", "canonical"], "left")
    per_kind = mapping.groupBy("kind").agg(F.count(F.lit(1)).alias("seed"))
    used = F.coalesce(F.max(F.nullif(F.regexp_extract("codename", r"^\[Empresa-(\d+)\]$", 1), F.lit("")).cast("int")), F.lit(0))
    # One row: the project codename's use and the highest company number so far.
    state = mapping.where("kind = 'ORG'").agg(used.alias("org_seed"), F.coalesce(F.bool_or(F.col("codename") == codename), F.lit(False)).alias("main_used"))
    main = _is_main(main_company)
    by_account = F.lit(mode != "sequential") & F.col("kind").isin(*lex.LEDGER_KINDS) & (F.size("account_codes") > 0)
    status = F.when(F.col("known").isNotNull(), "known").when(main, "main").when(by_account, "account").otherwise("running")
    rows = rows.withColumn("status", status).join(per_kind, "kind", "left").join(F.broadcast(state), F.lit(True))
    order = Window.partitionBy("kind", "status").orderBy(F.desc("total_count"), "canonical")
    number = F.row_number().over(order)
    skip = F.when(F.lit(bool(main_company.strip())) | F.col("main_used"), 0).otherwise(1)
    running = (
        F.when(F.col("kind") != "ORG", names.placeholder(F.col("kind"), F.coalesce("seed", F.lit(0)) + F.col("number")))
        .when(F.col("number") <= skip, F.lit(codename))
        .otherwise(names.placeholder(F.col("kind"), F.col("org_seed") + F.col("number") - skip))
    )
    account = names.account_codename(F.col("kind"), F.try_element_at("account_codes", F.lit(1)), "short" if mode == "account_short" else "full")
    rows = rows.withColumn("number", number)
    rows = rows.withColumn("codename", F.when(F.col("status") == "known", F.col("known")).when(F.col("status") == "main", F.lit(codename)).when(F.col("status") == "account", account).otherwise(running))
    out = rows.select("kind", "canonical", "variants", "account_codes", "total_count", "codename")
    if main_company.strip():
        name = main_company.strip()
        extra = spark.createDataFrame([("ORG", name, [name], [], 0, codename)], "kind string, canonical string, variants array<string>, account_codes array<string>, total_count long, codename string")
        out = out.unionByName(extra.join(out.where(F.col("codename") == codename).limit(1).select(F.lit(1).alias("hit")), F.lit(True), "left_anti"))
    return with_review_columns(out)


def merge_same_names(clusters: DataFrame) -> DataFrame:
    """Clusters of one kind whose canonical names differ in case or outer blanks become one row."""
    key = F.lower(F.trim("canonical"))
    best = F.struct("total_count", "canonical", "variants", "account_codes")
    grouped = clusters.groupBy("kind", key.alias("key")).agg(F.sum("total_count").alias("total_count"), F.array_sort(F.collect_list(best)).alias("parts"))
    last = F.element_at("parts", -1)
    return grouped.select("kind", last["canonical"].alias("canonical"), F.array_distinct(F.flatten(F.reverse(F.transform("parts", lambda p: p["variants"])))).alias("variants"), "total_count", F.array_distinct(F.flatten(F.reverse(F.transform("parts", lambda p: p["account_codes"])))).alias("account_codes"))


def with_review_columns(rows: DataFrame) -> DataFrame:
    types = F.create_map(*[F.lit(x) for kv in lex.KIND_TO_TYPE.items() for x in kv])
    order = Window.orderBy(F.desc("total_count"), "canonical", "kind")
    return rows.select(
        (F.row_number().over(order) - 1).alias("row_id"),
        F.lit(True).alias("anonymise"),
        F.coalesce(F.try_element_at(types, F.col("kind")), F.lit("Empresa")).alias("type"),
        "kind",
        "canonical",
        "variants",
        "account_codes",
        F.coalesce(F.nullif(F.array_join(F.array_except("variants", F.array("canonical")), " | "), F.lit("")), F.lit("—")).alias("other_variants"),
        F.coalesce(F.nullif(F.array_join("account_codes", ", "), F.lit("")), F.lit("—")).alias("accounts"),
        "total_count",
        "codename",
    )


def apply_edits(review: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(row_id, anonymise, type, codename): non-null values replace those of the review row."""
    kinds = F.create_map(*[F.lit(x) for kv in lex.TYPE_TO_KIND.items() for x in kv])
    e = edits.select("row_id", *[F.col(c).alias(f"new_{c}") for c in ("anonymise", "type", "codename")])
    joined = review.join(e, "row_id", "left")
    out = joined.withColumn("kind", F.coalesce(F.when(F.col("new_type") != F.col("type"), F.try_element_at(kinds, F.col("new_type"))), F.col("kind")))
    for c in ("anonymise", "type", "codename"):
        out = out.withColumn(c, F.coalesce(f"new_{c}", c))
    return out.select(*review.columns)


def set_anonymise(review: DataFrame, value: bool | None, types: tuple[str, ...] = ()) -> DataFrame:
    """Select (True), clear (False) or invert (None) the rows of the given types, or all rows."""
    hit = F.col("type").isin(*types) if types else F.lit(True)
    new = ~F.col("anonymise") if value is None else F.lit(value)
    return review.withColumn("anonymise", F.when(hit, new).otherwise(F.col("anonymise")))


def merge_rows(review: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions(row_id, codename): members of a suggestion take the chosen codename."""
    return apply_edits(review, decisions.select("row_id", F.lit(None).cast("boolean").alias("anonymise"), F.lit(None).cast("string").alias("type"), "codename"))


def drop_variants(review: DataFrame, wrong: DataFrame) -> DataFrame:
    """wrong(row_id, variant): variants that don't belong to their row."""
    listed = wrong.groupBy("row_id").agg(F.collect_set("variant").alias("wrong"))
    joined = review.join(listed, "row_id", "left")
    kept = F.when(F.col("wrong").isNull(), F.col("variants")).otherwise(F.array_except("variants", "wrong"))
    return joined.withColumn("variants", kept).select(*review.columns)


def merge_suggestions(review: DataFrame, max_block: int = 600) -> DataFrame:
    """(group, row_id, canonical, total_count, target): members of each suggested merge.

    The group is its first row's id; the target is the codename of its most frequent member, the
    first of equals.
    """
    entries = review.select(F.col("row_id").alias("id"), "kind", F.col("canonical").alias("name"))
    groups = suggestion_groups(entries, max_block).select(F.get("ids", F.lit(0)).alias("group"), F.explode("ids").alias("row_id"))
    members = groups.join(review.select("row_id", "canonical", "total_count", "codename"), "row_id")
    target = members.groupBy("group").agg(F.max_by("codename", F.struct("total_count", -F.col("row_id"))).alias("target"))
    return members.join(target, "group").select("group", "row_id", "canonical", "total_count", "target")


def unify(review: DataFrame, suggestions: DataFrame, choices: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The review table after all suggested merges at once.

    choices(row_id, group): rows that go to another group, or with a null group to none;
    targets(group, codename): codenames chosen for groups, an empty one leaves its members alone.
    """
    spark = review.sparkSession
    choices = spark.createDataFrame([], "row_id long, group long") if choices is None else choices
    targets = spark.createDataFrame([], "group long, codename string") if targets is None else targets
    chosen = choices.select("row_id", F.col("group").alias("other"), F.lit(True).alias("moved"))
    rows = suggestions.join(chosen, "row_id", "left").withColumn("goes", F.when(F.col("moved"), F.col("other")).otherwise(F.col("group")))
    named = suggestions.select(F.col("group").alias("goes"), "target").distinct().join(targets.select(F.col("group").alias("goes"), "codename"), "goes", "left")
    named = named.select("goes", F.trim(F.coalesce("codename", "target")).alias("codename"))
    return merge_rows(review, rows.select("row_id", "goes").join(named, "goes").where("codename <> ''").select("row_id", "codename"))


def review_to_mapping(review: DataFrame, project: str) -> DataFrame:
    """Checked rows with a codename, one entry for each variant."""
    kinds = list(lex.KIND_LABELS)
    rows = review.where(F.col("anonymise") & (F.coalesce(F.trim("codename"), F.lit("")) != "")).select("kind", "codename", "row_id", F.posexplode("variants").alias("pos", "original"))
    order = Window.partitionBy("kind").orderBy("row_id", "pos")
    return rows.select(F.lit(project).alias("project"), "kind", (F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")) - 1).cast("int").alias("kind_ord"), "original", (F.row_number().over(order) - 1).alias("entry_ord"), "codename")


def codename_collisions(review: DataFrame) -> DataFrame:
    """Codenames that several canonical names share: rehydration would keep only one of them."""
    return review.groupBy("codename").agg(F.count_distinct("canonical").alias("names"), F.array_sort(F.collect_set("canonical")).alias("canonicals")).where("names > 1")
