"""Detection over fragments(batch_id, doc_id, file_ord, seq, channel, sheet, row, col, text).

Detection runs once for each distinct text; counts are non-overlapping substring counts over the
batch. The window before an identifier crosses fragment and file borders through a bounded frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velario.functions import lexicon as lex
from velario.functions import names
from velario.functions.identifiers import LABEL_WINDOW, PATTERNS, find_all, keep_id, matches_with_context
from velario.operators.lineage import sorted_side
from velario.operators.occurrence import name_hits

#: Fragments of a file that one task orders.
BLOCK = 10_000
CANDIDATE = ("text", "kind", "count", "source", "account_code")

#: Shapes of company names; fixed values.
ORG_SHAPE = (
    r"(?U)\b([A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ&./\- ]{1,70}?)[,\s]+"
    r"(S\.?L\.?U\.?|S\.?A\.?U\.?|S\.?L\.?L\.?|S\.?L\.?P\.?|S\.?L\.?|S\.?A\.?|S\.?Coop\.?|S\.?C\.?P\.?|S\.?C\.?|Ltda?\.?|Limited|Inc\.?|Corp\.?|GmbH|AG|BV|NV|PLC)"
    "(?=\\s|$|[,;:.)\"'\\n])"
)
UPPER_SHAPE = r"(?U)\b([A-ZÁÉÍÓÚÑ]{3,}(?:[ &\-][A-ZÁÉÍÓÚÑ]{2,}){1,5})\b"
SUFFIX_SHAPE = (
    r"[ \t]*,?[ \t]*(?:S\.?L\.?U\.?|S\.?A\.?U\.?|S\.?L\.?L\.?|S\.?L\.?P\.?|S\.?L\.?|S\.?A\.?|S\.?Coop\.?|Ltd\.?|Inc\.?|Corp\.?|GmbH|AG|BV|NV)"
    "(?=\\s|$|[,;:\\)\"\\'])"
)


def with_previous_text(fragments: DataFrame, width: int = LABEL_WINDOW, block: int = BLOCK) -> DataFrame:
    """Column ``before``: the last characters ahead of each fragment, in its file or the files before.

    fragments: batch_id, file_ord, doc_id and seq, which counts a file's fragments from 0. ``width``
    fragments always suffice, since each adds a line feed. A file is cut into blocks of ``block``
    fragments, each led by the last ``width`` of the block before, so no task holds a whole file.
    Only the end of each file, one row, goes on to the files after it.
    """
    file = ["batch_id", "file_ord", "doc_id"]
    tail = F.coalesce(F.right("text", F.lit(width)), F.lit(""))
    ends = fragments.select(*file, "seq", tail.alias("tail"), F.floor(F.col("seq") / block).alias("block"))
    lead = ends.where(F.col("seq") % block >= block - width).withColumn("block", F.col("block") + 1)
    within = Window.partitionBy(*file, "block").orderBy("seq").rowsBetween(-width, -1)
    marked = ends.withColumn("own", F.lit(True)).unionByName(lead.withColumn("own", F.lit(False)))
    inside = marked.withColumn("inside", F.array_join(F.collect_list("tail").over(within), "\n")).where("own").select(*file, "seq", "inside")
    last = ends.groupBy(*file).agg(F.max("seq").alias("last"))
    closing = ends.join(last, file).where(F.col("seq") > F.col("last") - width).groupBy(*file).agg(F.array_sort(F.collect_list(F.struct("seq", "tail"))).alias("ends"))
    closing = closing.select(*file, F.right(F.array_join(F.transform("ends", lambda e: e["tail"]), "\n"), F.lit(width)).alias("end"))
    earlier = Window.partitionBy("batch_id").orderBy("file_ord", "doc_id").rowsBetween(-width, -1)
    ahead = closing.select(*file, F.array_join(F.collect_list("end").over(earlier), "\n").alias("ahead"))
    joined = fragments.join(inside, [*file, "seq"]).join(ahead, file)
    whole = F.concat("ahead", F.when(F.col("seq") == 0, F.lit("")).otherwise(F.lit("\n")), "inside", F.lit("\n"))
    return joined.withColumn("before", F.right(whole, F.lit(width))).select(*fragments.columns, "before")


def structured_matches(fragments: DataFrame) -> DataFrame:
    """(batch_id, doc_id, kind, value): identifiers with a right checksum or a label, and
    addresses, e-mail addresses and phones; a value that is a CIF is not also a NIF.

    ``fragments`` may carry ``before`` (see with_previous_text).
    """
    text = F.coalesce("text", F.lit(""))
    before = F.col("before") if "before" in fragments.columns else None
    found = []
    for kind, pattern in PATTERNS.items():
        if kind in lex.ID_LABELS:
            kept = F.filter(matches_with_context(text, pattern, before), _kept(kind))
            values = F.transform(kept, lambda m: m["value"])
        else:
            values = find_all(text, pattern)
        found.append(F.transform(values, _tag(kind)))
    rows = fragments.select("batch_id", "doc_id", F.explode(F.concat(*found)).alias("m")).select("batch_id", "doc_id", F.col("m.kind").alias("kind"), F.col("m.value").alias("value"))
    cif = rows.where("kind = 'CIF'").select("batch_id", "value", F.lit("NIF").alias("kind")).distinct()
    return rows.join(sorted_side(cif), ["batch_id", "value", "kind"], "left_anti").select("batch_id", "doc_id", "kind", "value")


def _kept(kind: str) -> Callable[[Column], Column]:
    return lambda m: keep_id(kind, m["value"], m["context"])


def _tag(kind: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def substring_counts(values: DataFrame, fragments: DataFrame, column: str = "value") -> DataFrame:
    """Distinct values with their non-overlapping substring count over the fragments."""
    text = fragments.where("text is not null and text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    hits = name_hits(text, values, "text", column, ["copies"])
    return hits.groupBy(column).agg(F.sum(F.col("hits") * F.col("copies")).cast("long").alias("count"))


def structured_candidates(fragments: DataFrame) -> DataFrame:
    matches = structured_matches(fragments)
    counts = substring_counts(matches, fragments)
    return matches.select("kind", "value").distinct().join(sorted_side(counts), "value").select(F.col("value").alias("text"), "kind", "count", F.lit("regex").alias("source"), F.lit(None).cast("string").alias("account_code"))


def distinct_texts(fragments: DataFrame) -> DataFrame:
    return fragments.where("text is not null and text <> ''").select("text").distinct()


def heuristic_orgs(fragments: DataFrame) -> DataFrame:
    """(text, count): names with a company suffix, and runs of upper-case words."""
    texts = distinct_texts(fragments)
    full = texts.select(F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(ORG_SHAPE), F.lit(0)).alias("full"), F.regexp_extract_all("text", F.lit(ORG_SHAPE), F.lit(1)).alias("part"))).alias("m"))
    full = full.select(F.rtrim(F.regexp_replace(F.trim("m.full"), ",+$", "")).alias("text"), F.trim("m.part").alias("part")).where(~names.is_stopword(F.col("part")) & ~names.is_artefact(F.col("text"))).select("text")
    upper = texts.select(F.explode(F.regexp_extract_all("text", F.lit(UPPER_SHAPE), F.lit(1))).alias("text")).select(F.trim("text").alias("text"))
    stop = F.array(*[F.lit(w) for w in lex.STOPWORDS])
    plain = F.forall(F.split("text", r"\s+"), lambda t: F.array_contains(stop, F.lower(t)))
    upper = upper.where(~names.is_stopword(F.col("text")) & ~plain & ~names.is_artefact(F.col("text")))
    return full.unionByName(upper).groupBy("text").agg(F.count(F.lit(1)).alias("count"))


def heuristic_persons(fragments: DataFrame) -> DataFrame:
    """(text, count): a given name and one or two capitalised words; the scan resumes after them."""
    given, stop = F.array(*[F.lit(w) for w in lex.GIVEN_NAMES]), F.array(*[F.lit(w) for w in lex.STOPWORDS])
    words = distinct_texts(fragments).select(F.transform(F.filter(F.split("text", r"(?U)\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, "^[.,;:()\"']+|[.,;:()\"']+$", "")).alias("w"))
    given_at = F.transform("w", lambda t: F.array_contains(given, F.lower(t)))
    surname = F.transform("w", lambda t: t.rlike(r"(?U)^\p{Lu}\p{L}*$") & ~F.array_contains(stop, F.lower(t)))
    flagged = words.withColumns({"g": given_at, "s": surname}).where(F.exists("g", lambda x: x))
    state = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        first = F.coalesce(F.get("s", i + 1), F.lit(False))
        second = first & F.coalesce(F.get("s", i + 2), F.lit(False))
        starts = F.get("g", i) & (i >= acc["next"])
        taken = F.when(second, 3).when(first, 2).otherwise(1)
        name = F.array_join(F.slice("w", i + 1, taken), " ")
        return F.struct(F.when(starts, i + taken).otherwise(acc["next"]).alias("next"), F.when(starts & first, F.concat(acc["out"], F.array(name))).otherwise(acc["out"]).alias("out"))

    found = flagged.select(F.explode(F.aggregate(F.sequence(F.lit(0), F.size("w") - 1), state, step, lambda acc: acc["out"])).alias("text"))
    return found.groupBy("text").agg(F.count(F.lit(1)).alias("count"))


def suffix_variants(orgs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(text, count): each company name as it stands with a suffix somewhere, not yet listed."""
    named = orgs.select(F.col("text").alias("org"), F.lower("text").alias("name")).distinct()
    texts = distinct_texts(fragments).withColumn("low", F.lower("text"))
    met = name_hits(texts, named, "low", "name", ["text"]).join(sorted_side(named), "name")
    pattern = F.concat(F.lit("(?iU)\\Q"), F.replace("org", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), F.lit(SUFFIX_SHAPE))
    found = met.select("org", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("v")).select("org", F.rtrim(F.regexp_replace(F.trim("v"), ",+$", "")).alias("text"))
    new = found.where("text <> org").select("text").distinct().join(sorted_side(orgs.select("text")), "text", "left_anti")
    return substring_counts(new.withColumnRenamed("text", "value"), fragments).withColumnRenamed("value", "text")


def _candidates(rows: DataFrame, kind: str, source: str) -> DataFrame:
    return rows.select("text", F.lit(kind).alias("kind"), "count", F.lit(source).alias("source"), F.lit(None).cast("string").alias("account_code"))


def detect_candidates(fragments: DataFrame, skip_ner: bool = False, layers: tuple[Callable[[DataFrame, DataFrame], DataFrame], ...] = (), tagger: Callable | None = None) -> DataFrame:
    """All candidates (text, kind, count, source, account_code) of the fragments.

    ``layers`` are optional model layers: each takes (fragments, candidates so far) and returns
    further candidates (see model_layer). The fragments are read several times: pass a written
    table or a checkpoint.
    """
    if "before" not in fragments.columns:
        fragments = with_previous_text(fragments)
    found = structured_candidates(fragments)
    return found if skip_ner else found.unionByName(name_candidates(fragments, layers, found, tagger))


def name_candidates(fragments: DataFrame, layers: tuple[Callable[[DataFrame, DataFrame], DataFrame], ...] = (), known: DataFrame | None = None, tagger: Callable | None = None) -> DataFrame:
    """The candidates of the fragments beside identifiers; layers see ``known`` and what is found before them.

    ``tagger`` (see models.tagged_names) takes the place of the rules where it is given.
    """
    nothing = known if known is not None else _candidates(fragments.select("text", F.lit(0).cast("long").alias("count")).where(F.lit(False)), "ORG", "ner")
    if tagger is None:
        orgs, persons, places = heuristic_orgs(fragments), heuristic_persons(fragments), None
    else:
        tagged, places = tagger(fragments, nothing)
        orgs, persons = (tagged.where(F.col("kind") == k).select("text", "count") for k in ("ORG", "PER"))
    orgs = orgs.unionByName(suffix_variants(orgs, fragments))
    found = _candidates(orgs, "ORG", "ner").unionByName(_candidates(persons, "PER", "ner"))
    if places is not None:
        found = found.unionByName(places.join(nothing.select("kind", "text"), ["kind", "text"], "left_anti").select(*found.columns))
    for layer in layers:
        found = found.unionByName(layer(fragments, found if known is None else known.unionByName(found)))
    return found


def entity_rows(texts: DataFrame, extract: Callable, chunk_chars: int = 3000) -> DataFrame:
    """(text, label, score) that ``extract(texts) -> lists of (text, label, score)`` finds in whole texts, chunk by chunk."""
    chunks = texts.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk_chars).cast("int")), lambda i: F.substring("text", i * chunk_chars + 1, F.lit(chunk_chars)))).alias("text"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            hits = [(t.strip(), label, float(score)) for found in extract(frame["text"].tolist()) for t, label, score in found]
            yield pd.DataFrame(hits, columns=["text", "label", "score"])

    return chunks.mapInPandas(run, "text string, label string, score double")


def model_layer(extract: Callable, name: str, label_kinds: dict[str, str], threshold: float = 0.5, chunk_chars: int = 3000, other_kind: str | None = None, clean: Callable[[Column], Column] = F.trim, drop_given_names: bool = True) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A layer around ``extract(texts) -> list of lists of (text, label, score)``.

    Texts are cut into chunks and go to ``extract`` in Arrow batches; results under the threshold,
    noise, lone given names and texts already found (in any case) are dropped. Labels without a kind
    get ``other_kind``, or go. The count is that of the text in all fragments, 1 at least; the fine
    label stays in ``source`` as ``name:LABEL``.
    """

    def layer(fragments: DataFrame, known: DataFrame) -> DataFrame:
        raw = entity_rows(distinct_texts(fragments), extract, chunk_chars).withColumn("text", clean(F.col("text")))
        kinds = F.create_map(*[F.lit(x) for kv in label_kinds.items() for x in kv])
        kept = raw.withColumn("kind", F.coalesce(F.try_element_at(kinds, F.col("label")), F.lit(other_kind))).where((F.col("score") >= threshold) & F.col("kind").isNotNull())
        kept = kept.where((F.length("text") > 0) & ~names.is_stopword(F.col("text")) & ~names.is_artefact(F.col("text")))
        if drop_given_names:
            kept = kept.where((F.length("text") >= 2) & ~names.is_lone_given_name(F.col("text")))
        new = kept.withColumn("low", F.lower("text")).join(known.select(F.lower(F.trim("text")).alias("low")).distinct(), "low", "left_anti")
        best = new.groupBy("low").agg(F.max_by(F.struct("text", "kind", "label"), F.struct("score", "text", "label")).alias("b")).select("b.*")
        counted = substring_counts(best.select("text"), fragments, "text").withColumnRenamed("text", "t")
        joined = best.join(counted, F.col("text") == F.col("t"), "left")
        return joined.select("text", "kind", F.coalesce("count", F.lit(1)).alias("count"), F.concat(F.lit(f"{name}:"), "label").alias("source"), F.lit(None).cast("string").alias("account_code"))

    return layer
