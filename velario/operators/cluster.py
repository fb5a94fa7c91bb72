"""Clusters of spelling variants, merge suggestions, and the two clean-ups between kinds.

Candidates are first reduced to distinct (kind, text), so a name that a third of all rows hold is
one row here. Comparisons never leave a block (kind, first two characters of the normalised name),
which makes blocks independent; the greedy leader rule inside a block is sequential by definition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velario.functions import lexicon as lex
from velario.functions import names
from velario.functions.similarity import NameBlock, NearNames, Pattern, tokens_sorted
from velario.operators.lineage import cut, sorted_side

THRESHOLD = 90
MAX_LENGTH_GAP = 6
MIN_FUZZY = 5
CLUSTER_SCHEMA = "kind string, canonical string, variants array<string>, total_count long, account_codes array<string>"


def merged_candidates(candidates: DataFrame) -> DataFrame:
    """One row for each (kind, text): counts add up; a text's account codes, one of each source, are sorted."""
    codes = F.array_sort(F.collect_set("account_code"))
    return candidates.groupBy("kind", "text").agg(F.sum("count").cast("long").alias("count"), codes.alias("codes"))


def _norm() -> Column:
    return F.when(F.col("kind").isin(*lex.ORG_LIKE_KINDS), names.normalize_org(F.col("text"))).otherwise(names.normalize_person(F.col("text")))


def leaders(frame: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Greedy leader clusters of one block, longest texts first."""
    frame = frame.assign(length=frame["text"].str.len()).sort_values(["length", "count", "text"], ascending=[False, False, True])
    heads: list[tuple[str, str, dict]] = []
    homes: dict[str, dict] = {}  # equal names have one home: leaders made later come after it
    near = NearNames(threshold)
    for row in frame.itertuples():
        home = homes.get(row.norm)
        if home is None:
            ordered = tokens_sorted(row.norm)
            plain, by_token = Pattern(row.norm), Pattern(ordered)
            for norm, tokens, cluster in map(heads.__getitem__, near.places(ordered)):
                if abs(len(norm) - len(row.norm)) <= MAX_LENGTH_GAP and by_token.may_reach(tokens, threshold) and by_token.ratio(tokens) >= threshold and plain.ratio(norm) >= threshold - 10:
                    home = cluster
                    break
        if home is None:
            home = {"kind": row.kind, "canonical": row.text, "variants": [], "total_count": 0, "account_codes": []}
            heads.append((row.norm, ordered, home))
            near.add(ordered)
        homes[row.norm] = home
        home["variants"].append(row.text)
        home["total_count"] += int(row.count_)
        home["account_codes"] += [c for c in row.codes if c not in home["account_codes"]]
    return pd.DataFrame([c for *_, c in heads], columns=["kind", "canonical", "variants", "total_count", "account_codes"])


def _leader_task(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return leaders(frame.assign(count_=frame["count"]), threshold)

    return run


def leader_clusters(candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Clusters before the clean-ups between kinds."""
    merged = merged_candidates(candidates).withColumn("norm", _norm())
    single = F.col("kind").isin(*lex.STRUCTURED_KINDS) | (F.length("norm") < MIN_FUZZY)
    fuzzy = merged.where(~single).withColumn("block", F.substring("norm", 1, 2))
    alone = merged.where(single & (F.col("kind").isin(*lex.STRUCTURED_KINDS) | (F.col("norm") != "")))
    grouped = fuzzy.groupBy("kind", "block").applyInPandas(_leader_task(threshold), CLUSTER_SCHEMA)
    return grouped.unionByName(alone.select("kind", F.col("text").alias("canonical"), F.array("text").alias("variants"), F.col("count").alias("total_count"), F.col("codes").alias("account_codes")))


def drop_covered(clusters: DataFrame) -> DataFrame:
    """Without ORG and PER clusters that a ledger name covers, whole or as a rare short part.

    Parts and full names meet on the part's first four characters, a four-gram of the full name.
    """
    ledger = clusters.where(F.col("kind").isin(*lex.LEDGER_KINDS)).select(F.explode("variants").alias("v"))
    known = ledger.select(F.explode(F.array(names.normalize_org(F.col("v")), names.normalize_person(F.col("v")))).alias("known")).distinct()
    own = clusters.where(F.col("kind").isin("ORG", "PER")).select("kind", "canonical", "total_count", F.explode("variants").alias("v"))
    own = own.select("kind", "canonical", "total_count", names.normalize_org(F.col("v")).alias("org"), names.normalize_person(F.col("v")).alias("per"))
    exact = own.select("kind", "canonical", F.explode(F.array("org", "per")).alias("known")).join(sorted_side(known), "known", "left_semi")
    full = known.where(F.length("known") >= 4).withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("known") - 3), lambda i: F.substring("known", i, F.lit(4))))))
    part = own.where((F.length("org") >= 4) & (F.col("total_count") < 3)).withColumn("gram", F.substring("org", 1, 4))
    inside = part.join(sorted_side(full), "gram").where(F.contains("known", "org") & (F.col("org") != F.col("known")) & (F.length("org") < 0.6 * F.length("known")))
    covered = exact.select("kind", "canonical").unionByName(inside.select("kind", "canonical")).distinct()
    return clusters.join(sorted_side(covered), ["kind", "canonical"], "left_anti")


def merge_persons(clusters: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """PER clusters that read like an ORG variant join that ORG, the first in cluster order.

    Names meet on their first two or last two normalised characters, long ones also on any four
    in a row: a name under 20 characters that differs at both ends stays under 90, and a longer
    one at 90 or more keeps four characters in a row. Persons join one after the other, and those
    that have joined count as variants of their ORG for the persons after them: that is a fixed
    point, reached in as many rounds as the longest chain has names.
    """
    variants = F.explode("variants").alias("v")
    orgs = clusters.where("kind = 'ORG'").select(_cluster_order().alias("org"), variants).select("org", names.normalize_org(F.col("v")).alias("org_norm")).distinct()
    persons = clusters.where("kind = 'PER'").select(_cluster_order().alias("per"), "canonical", "variants", names.normalize_org(F.col("canonical")).alias("norm"))
    persons = cut(persons)
    own = _near(persons.select("per", "norm"), orgs, "org", threshold)
    earlier = persons.select(F.col("per").alias("first"), F.explode("variants").alias("v")).select("first", names.normalize_org(F.col("v")).alias("org_norm")).distinct()
    chained = cut(_near(persons.select("per", "norm"), earlier, "first", threshold).where("first < per"))
    own = cut(own)
    home = own.groupBy("per").agg(F.min("org").alias("org"))
    if not chained.isEmpty():
        home, before = cut(home), -1
        while True:
            via = chained.join(home.select(F.col("per").alias("first"), "org"), "first").select("per", "org")
            home = cut(own.unionByName(via).groupBy("per").agg(F.min("org").alias("org")))
            now = home.agg(F.bit_xor(F.xxhash64("per", "org"))).first()[0]
            if now == before:
                break
            before = now
    home = home.join(persons.select("per", "canonical"), "per").select("canonical", F.col("org.text").alias("org"), "per")
    joined = persons.select("canonical", "variants").join(sorted_side(home), "canonical").join(sorted_side(clusters.where("kind = 'PER'").select("canonical", "total_count")), "canonical")
    moved = joined.groupBy("org").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("per", "variants"))), lambda p: p["variants"])).alias("more"), F.sum("total_count").alias("more_count")).withColumnRenamed("org", "canonical").withColumn("kind", F.lit("ORG"))
    kept = clusters.join(sorted_side(home.select("canonical", F.lit("PER").alias("kind"))), ["kind", "canonical"], "left_anti").join(sorted_side(moved), ["kind", "canonical"], "left")
    return kept.select("kind", "canonical", F.when(F.col("more").isNull(), F.col("variants")).otherwise(F.concat("variants", "more")).alias("variants"), (F.col("total_count") + F.coalesce("more_count", F.lit(0))).alias("total_count"), "account_codes")


def _cluster_order() -> Column:
    """Clusters in the order in which leaders are made: longest canonical name, then most frequent."""
    return F.struct((-F.length("canonical")).alias("n"), (-F.col("total_count")).alias("c"), F.col("canonical").alias("text"))


def _near(left: DataFrame, right: DataFrame, key: str, threshold: float) -> DataFrame:
    """(per, key) of left(per, norm) and right(key, org_norm) whose names reach the threshold."""
    from velario.functions.similarity import indel_ratio

    def ends(norm: Column) -> Column:
        grams = F.when(F.length(norm) >= 18, F.transform(F.sequence(F.lit(1), F.length(norm) - 3), lambda i: F.substring(norm, i, F.lit(4)))).otherwise(F.array().cast("array<string>"))
        return F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("<"), F.substring(norm, 1, 2)), F.concat(F.lit(">"), F.right(norm, F.lit(2)))), grams)))

    met = left.select("per", "norm", ends(F.col("norm")).alias("end")).join(right.select(key, "org_norm", ends(F.col("org_norm")).alias("end")), "end")
    fits = F.abs(F.length("norm") - F.length("org_norm")) * 9 <= F.length("norm") + F.length("org_norm")
    pairs = met.where(fits).select("per", "norm", key, "org_norm").distinct()
    return pairs.where(indel_ratio(F.col("norm"), F.col("org_norm")) >= threshold).select("per", key).distinct()


def cluster_variants(candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Clusters of all kinds; order them by (-total_count, canonical) for display."""
    led = cut(leader_clusters(candidates, threshold))  # read by each clean-up; names, not rows
    return merge_persons(cut(drop_covered(led)), threshold)


def similar_pairs(entries: DataFrame) -> DataFrame:
    """entries(id, kind, name) -> (kind, id_a, id_b) of one block worth a merge suggestion."""
    from velario.functions.similarity import is_prefix, may_be_near, may_be_same

    keyed = entries.where(F.col("kind").isin(*lex.UNIFIABLE_KINDS)).withColumn("norm", names.normalize_org(F.col("name"))).where("norm <> ''")
    keyed = keyed.withColumn("block", F.substring("norm", 1, 2))
    other = keyed.select("kind", "block", F.col("id").alias("id_b"), F.col("norm").alias("norm_b"))
    left = keyed.select("kind", "block", F.col("id").alias("id_a"), F.col("norm").alias("norm_a"))
    # A ratio of 82 or more needs lengths within 36 parts in 164; prefixes have any length.
    band = is_prefix(F.col("norm_a"), F.col("norm_b")) | may_be_near(F.col("norm_a"), F.col("norm_b"))
    pairs = left.join(other, ["kind", "block"]).where((F.col("id_a") < F.col("id_b")) & band)
    return pairs.where(may_be_same(F.col("norm_a"), F.col("norm_b"))).select("kind", "id_a", "id_b")


def suggestion_groups(entries: DataFrame, max_block: int = 600) -> DataFrame:
    """(kind, ids): stars of a first entry and the unused entries like it; id is the entry order.

    Suggestions are a display feature: blocks of more than ``max_block`` names give none.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(frame["id"], frame["norm"], strict=True))
        used: set = set()
        groups, block = [], NameBlock([tokens_sorted(norm) for _, norm in rows])
        for a, norm_a in rows:
            if a in used:
                continue
            alike = _alike(norm_a, [norm for _, norm in rows], block)
            group = [a, *(rows[k][0] for k in alike if rows[k][0] != a and rows[k][0] not in used)]
            if len(group) > 1:
                groups.append(group)
                used.update(group)
        kinds = [frame["kind"].iloc[0]] * len(groups)
        return pd.DataFrame({"kind": pd.Series(kinds, dtype=object), "ids": pd.Series(groups, dtype=object)})

    keyed = entries.where(F.col("kind").isin(*lex.UNIFIABLE_KINDS)).withColumn("norm", names.normalize_org(F.col("name"))).where("norm <> ''").withColumn("block", F.substring("norm", 1, 2))
    sizes = keyed.groupBy("kind", "block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= max_block)
    return keyed.join(sizes, ["kind", "block"]).groupBy("kind", "block").applyInPandas(run, "kind string, ids array<long>")


def _alike(a: str, others: list[str], block: NameBlock) -> list[int]:
    """Places of the normalised names worth a merge suggestion with ``a``, as may_be_same says."""
    sizes, n = np.array([len(b) for b in others]), len(a)
    short = np.minimum(sizes, n)
    near = np.zeros(len(others), bool)
    if n >= 6 and ((short >= 6) & (short * 200 >= (sizes + n) * 82)).any():
        ratios = block.ratios(tokens_sorted(a))
        near = (short >= 6) & (ratios >= 82) & (ratios < 95)
    prefix = [b != a and len(b) >= 4 and n >= 4 and (b.startswith(a) or a.startswith(b)) for b in others]
    return [k for k in np.flatnonzero(near | np.array(prefix, bool)) if others[k] != a]


def ranked(clusters: DataFrame) -> DataFrame:
    """Column ``rank`` by (-total_count, canonical) within each kind, for display and numbering."""
    return clusters.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("total_count"), "canonical")))
