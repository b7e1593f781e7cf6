"""Joins that fill, extend or cross-reference records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom import fixed_values as fv
from strandloom.functions import names, sequence
from strandloom.operators import mapping, skew
from strandloom.functions.space import strip


def interaction_pairs(aptamers: DataFrame, interactions: DataFrame, block: int = skew.BLOCK_ROWS) -> DataFrame:
    """Aptamer-target pairs of every interaction with the aptamer's attributes.

    aptamers: id, label, sequence, has_modification_details
    interactions: int, has_participant, participant_label, dissociation_constant_value

    An interaction pairs each of its aptamers with each of its targets.  Equal rows are collapsed before they meet and
    repeated afterwards, and an interaction of very many rows is cut in blocks (``skew.block_join``).  Rows are dealt over
    partitions by their number before they are collapsed and where they meet, so a task's memory does not grow with the tables.
    """
    ids = aptamers.select(F.col("id").alias("has_participant")).distinct()
    parts = skew.parts_for(interactions)

    def counted(df: DataFrame, count: str, *columns: Column) -> DataFrame:
        rows = df.select(*columns)
        return rows.repartition(parts, *rows.columns).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(count))

    left = counted(
        interactions.join(ids, "has_participant", "left_semi"), "_na", F.col("int"), F.col("has_participant").alias("aptamer_uri"),
        F.col("dissociation_constant_value").alias("kd_molar"),
    )
    right = counted(
        interactions.join(ids, "has_participant", "left_anti"), "_nb", F.col("int"), F.col("participant_label").alias("target_name")
    )
    described = aptamers.withColumnRenamed("id", "aptamer_uri").withColumn(
        "sequence_clean", sequence.clean_sequence(F.col("sequence"))
    ).where(F.col("sequence_clean").isNotNull()).drop("sequence")
    met = skew.block_join(left.join(described, "aptamer_uri"), right, ["int"], block, parts=parts)
    copies = F.when(F.col("_na") * F.col("_nb") > 1, F.sequence(F.lit(1), F.col("_na") * F.col("_nb"))).otherwise(F.array(F.lit(1)))
    out = met.withColumn("_copy", F.explode(copies))
    return out.select(
        "aptamer_uri", "int", "kd_molar", "target_name", *[c for c in described.columns if c != "aptamer_uri"]
    ).withColumn("pmid", names.pmid_prefix(F.col("label")))


def label_lookup(pairs: DataFrame, order) -> DataFrame:
    """First pair of every lower-cased, trimmed label."""
    keyed = pairs.withColumn("label_key", F.lower(strip("label")))
    first = skew.keep_first(keyed, [F.col("label_key")], order=order)
    return first.select("label_key", "sequence_clean", "pmid", "target_name", "kd_molar")


def backfill_sequences(master: DataFrame, lookup: DataFrame) -> DataFrame:
    """Fill sequence and Kd of flagged rows by their ``label_key``."""
    hits = lookup.where(sequence.is_trainable_dna(F.col("sequence_clean"))).select(
        "label_key", F.col("sequence_clean").alias("_seq"), F.col("kd_molar").alias("_kd")
    )
    keyed = master.withColumn(
        "label_key", F.when(F.col("needs_sequence_enrichment"), F.lower(strip("label_key")))
    )
    joined = skew.attach(keyed, hits, ["label_key"])
    hit = F.col("_seq").isNotNull()
    return (
        joined.withColumn("sequence", F.coalesce("_seq", "sequence"))
        .withColumn("Kd_nM", F.when(hit & F.col("_kd").isNotNull(), F.col("_kd") * 1e9)
                    .otherwise(F.col("Kd_nM")))
        .withColumn("needs_sequence_enrichment", F.col("needs_sequence_enrichment") & ~hit)
        .select(*[c for c in master.columns if c != "label_key"])
    )


def new_rows(pairs: DataFrame, master: DataFrame, order) -> DataFrame:
    """Unmodified trainable pairs whose sequence is not in the master yet."""
    clean = pairs.where(
        F.col("has_modification_details").isNull()
        & sequence.is_trainable_dna(F.col("sequence_clean"))
    )
    first = skew.keep_first(
        clean, [F.col("sequence_clean"), F.col("target_name")], order=order
    )
    known = master.select(F.upper(strip("sequence")).alias("sequence_clean")).distinct()
    fresh = anti_by_key(first, known, "sequence_clean")
    return fresh.select(
        *mapping.legacy_row(
            sequence=F.col("sequence_clean"), target_protein=F.col("target_name"),
            Kd_nM=F.col("kd_molar") * 1e9, source_pmid=F.col("pmid"),
            training_tier=names.assign_tier(F.col("target_name")), source=F.lit("aptamerbase"),
        )
    )


def anti_by_key(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``known`` (distinct keys); NULL keys stay."""
    return skew.attach(df, known, [key], how="anti")


def merge_scraped(df: DataFrame, master: DataFrame) -> DataFrame:
    """Record rows that are new to a legacy master, as legacy rows.

    The master is compared on the normalised key; among the new rows the raw
    (sequence, target) pair is made distinct.
    """
    wanted = df.where(
        (strip("nucleic_acid_type") == "ssDNA") & (strip("target_type") == "protein")
    )
    mapped = mapping.to_legacy(wanted).where(
        sequence.is_trainable_dna(F.col("sequence")) & (F.col("target_protein") != "")
    )
    first = skew.keep_first(mapped, [F.col("sequence"), F.col("target_protein")])
    known = master.select(
        F.upper(strip("sequence")).alias("_s"), F.lower(strip("target_protein")).alias("_t")
    ).distinct()
    keyed = first.withColumn("_s", F.col("sequence")).withColumn("_t", F.lower("target_protein"))
    return keyed.join(known, ["_s", "_t"], "left_anti").select(*first.columns)


def curated_new(curated: DataFrame, known: DataFrame, schema: T.StructType) -> DataFrame:
    """Curated rows, aligned to the cleaned ``schema``, whose sequence and target ``known`` does not have."""
    fixed = {
        "split": F.lit("train"), "protein_sequence": F.lit(None).cast("string"),
        "label": F.lit(1), "training_tier": F.lit(2),
    }
    aligned = curated.select(
        "row_id",
        *[
            (fixed[n] if n in fixed else F.col(n).try_cast(schema[n].dataType)
             if n in curated.columns else F.lit(None).cast(schema[n].dataType)).alias(n)
            for n in fv.CLEANED_COLUMNS
        ],
    )
    keys = known.select(
        F.upper("aptamer_sequence").alias("_s"), F.lower("target_name").alias("_t")
    ).distinct()
    keyed = aligned.withColumn("_s", F.upper("aptamer_sequence")).withColumn(
        "_t", F.lower("target_name")
    )
    return skew.attach(keyed, keys, ["_s", "_t"], how="anti").select(*aligned.columns)


def curated_merge(cleaned: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated rows, aligned to the cleaned schema, that are not there yet."""
    new = curated_new(curated, cleaned, cleaned.schema)
    return cleaned.unionByName(new, allowMissingColumns=True)


def backfill_by_id(df: DataFrame) -> DataFrame:
    """Give rows without a protein sequence the first one of their id."""
    usable = F.length("protein_sequence") > 10
    table = (
        df.where(F.col("target_id").isNotNull())
        .groupBy("target_id")
        .agg(
            F.min(F.when(usable, F.struct("row_id", "protein_sequence")))["protein_sequence"]
            .alias("_found"),
            F.count_if(F.coalesce(F.col("protein_sequence"), F.lit("")) == "").alias("_rows"),
        )
        .where(F.col("_found").isNotNull() & (F.col("_rows") > 0))
    )
    gap = F.coalesce(F.col("protein_sequence"), F.lit("")) == ""
    keyed = df.withColumn("_id", F.when(gap, F.col("target_id")))
    filled = skew.spread_join(
        keyed, table.withColumnRenamed("target_id", "_id"), ["_id"], "_rows"
    )
    return filled.withColumn(
        "protein_sequence", F.coalesce(F.col("_found"), F.col("protein_sequence"))
    ).select(*df.columns)


def assign_existing(
    df: DataFrame, splits: DataFrame, seq: str = "sequence", target: str = "target_protein"
) -> DataFrame:
    """Add ``split`` from an older assignment, train before val before test.

    splits: sequence, target_protein, split, augmented; only unaugmented train
    rows count.  Rows without an assignment are 'unassigned'.
    """
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    usable = (F.col("split") != "train") | ~F.coalesce(F.col("augmented"), F.lit(False))
    table = (
        splits.where(F.col("split").isin(*fv.SPLITS) & usable)
        .groupBy(F.upper("sequence").alias("_s"), F.lower("target_protein").alias("_t"))
        .agg(F.min(rank).alias("_rank"))
    )
    keyed = df.withColumn("_s", F.upper(F.col(seq))).withColumn("_t", F.lower(F.col(target)))
    names_by_rank = F.get(F.array(*[F.lit(s) for s in fv.SPLITS]), F.col("_rank"))
    joined = keyed.join(table, ["_s", "_t"], "left")  # the table has one row per key
    return joined.select(
        *[c for c in df.columns if c != "split"],
        F.coalesce(names_by_rank, F.lit("unassigned")).alias("split"),
    )


def merge_extra(base: DataFrame, extra: DataFrame, wanted) -> DataFrame:
    """Append target-matched, plain-letter rows of a second source."""
    defaults = {
        "protein_sequence": F.lit(None).cast("string"), "label": F.lit(1),
        "training_tier": F.lit(2), "split": F.lit("train"),
    }
    for name, value in defaults.items():
        if name not in extra.columns:
            extra = extra.withColumn(name, value)
    rows = mapping.filter_targets(extra, wanted).where(F.col("aptamer_sequence").rlike("^[ATGC]+$"))
    return base.unionByName(rows, allowMissingColumns=True)


def resolve_override(df: DataFrame, overrides: DataFrame, proteins: DataFrame) -> DataFrame:
    """name -> accession -> sequence; adds ``accession`` and ``found_sequence``."""
    table = skew.keep_first(
        overrides.where(F.col("accession").isNotNull())
        .select(names.name_key(F.col("name")).alias("_key"), strip("accession").alias("accession")),
        [F.col("_key")], order=("accession",),
    )
    table = skew.attach(
        table, proteins.select("accession", F.col("protein_sequence").alias("found_sequence")), ["accession"], how="inner"
    )
    keyed = df.withColumn("_key", names.name_key(F.col("target_name")))
    return skew.attach(keyed, table, ["_key"]).drop("_key")


def _word_bits(words: Column) -> Column:
    """A word set in 64 bits; a word of the set has its bit."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(w).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseOR(bit(w)))


def resolve_names(
    targets: DataFrame, proteins: DataFrame, overrides: DataFrame | None = None, block: int = skew.BLOCK_ROWS
) -> DataFrame:
    """Best protein of every distinct target name, strategies in order.

    0 override, 1 exact name (human), 2 exact name (any), 3 noise-stripped name
    with token overlap >= 0.8 (human), 4 the same (any).

    proteins: accession, protein_name, is_human, protein_sequence.  Candidate
    pairs for the fuzzy step only meet on the rarest query words: of n words at
    least ceil(0.8 n) must be shared, so one of the n - ceil(0.8 n) + 1 rarest
    has to be, and only those are joined.  A word of very many names meets in blocks; names with too few words,
    or without the bits of enough query words, go before the words are compared.  An accession that was landed twice is one.
    """
    wanted = targets.select("target_name").where(F.col("target_name").isNotNull()).distinct()
    lower = wanted.withColumn("_key", names.name_key(F.col("target_name")))
    exact = lower.join(
        proteins.withColumn("_key", names.name_key(F.col("protein_name"))), "_key"
    ).select(
        "target_name", "accession", F.when(F.col("is_human"), 1).otherwise(2).alias("strategy"),
        F.lit(1.0).alias("score"),
    )
    parts = [exact]
    if overrides is not None:
        parts.append(
            resolve_override(wanted, overrides, proteins)
            .where(F.col("found_sequence").isNotNull())
            .select("target_name", "accession", F.lit(0).alias("strategy"), F.lit(1.0).alias("score"))
        )
    stripped = names.strip_noise(F.col("target_name"))
    query = (
        wanted.withColumn("_clean", stripped)
        .where((F.col("_clean") != "") & (F.col("_clean") != F.lower("target_name")))
        .withColumn("_q", names.word_set(F.col("_clean")))
    )
    words = proteins.select(
        "accession", "is_human", names.word_set(F.col("protein_name")).alias("_r")
    )
    words = words.distinct().withColumn("_rb", _word_bits(F.col("_r")))
    posting = words.select("accession", "is_human", "_r", "_rb", F.explode("_r").alias("word"))
    frequency = posting.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    asked = query.select("target_name", "_q", F.explode("_q").alias("word")).join(
        frequency, "word", "left"
    )
    need = F.ceil(F.size("_q") * F.lit(fv.TOKEN_OVERLAP_MIN) - F.lit(1e-9))
    # the query's own words only: a short array per distinct name
    ranked = asked.groupBy("target_name", "_q").agg(
        F.array_sort(
            F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "word"))
        ).alias("_w")
    )
    probe = ranked.select(
        "target_name", "_q", need.cast("int").alias("_need"), _word_bits(F.col("_q")).alias("_qb"),
        F.explode(F.slice("_w", 1, (F.size("_q") - need + 1).cast("int"))).alias("_p"),
    ).select("target_name", "_q", "_need", "_qb", F.col("_p.word").alias("word"))
    score = F.size(F.array_intersect("_q", "_r")) / F.size("_q")
    missing = F.bit_count(F.col("_qb").bitwiseAND(F.bitwise_not("_rb")))  # at least so many words of the query
    fuzzy = (
        skew.block_join(probe, posting, ["word"], block)
        .where((F.size("_r") >= F.col("_need")) & (missing <= F.size("_q") - F.col("_need")))
        .select(
            "target_name", "accession", F.when(F.col("is_human"), 3).otherwise(4).alias("strategy"),
            score.alias("score"),
        )
        .where(F.col("score") >= fv.TOKEN_OVERLAP_MIN)
    )
    parts.append(fuzzy)
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    best = (
        pool.select(
            "target_name",
            F.struct("strategy", (-F.col("score")).alias("s"), "accession").alias("_o"),
        )
        .groupBy("target_name").agg(F.min("_o").alias("_o"))
        .select(
            "target_name", F.col("_o.accession").alias("accession"),
            F.col("_o.strategy").alias("strategy"), (-F.col("_o.s")).alias("score"),
        )
    )
    return skew.attach(best, proteins.select("accession", "protein_sequence"), ["accession"], how="inner")


def resolve_compounds(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(df with CID ids on small molecules, distinct names without an id)."""
    small = F.col("target_type") == "small_molecule"
    keyed = df.withColumn("_name", F.when(small, F.col("target_name")))
    table = ids.select(F.col("name").alias("_name"), F.col("cid").alias("_cid"))
    joined = skew.attach(keyed, table, ["_name"])
    hit = F.col("_cid").isNotNull()
    filled = (
        joined.withColumn(
            "target_id",
            F.when(hit, F.concat(F.lit("CID:"), F.col("_cid"))).otherwise(F.col("target_id")),
        )
        .withColumn("target_id_source", F.when(hit, "PubChem").otherwise(F.col("target_id_source")))
        .select(*df.columns)
    )
    return filled, unresolved_compounds(df, ids)


def unresolved_compounds(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct names of small molecules without an id."""
    named = df.where((F.col("target_type") == "small_molecule") & F.col("target_name").isNotNull())
    return named.select("target_name").distinct().join(
        ids.select(F.col("name").alias("target_name")), "target_name", "left_anti"
    ).select(
        F.lit("5_pubchem").alias("phase"), F.lit("pubchem_lookup_failed").alias("reason"),
        "target_name", F.lit("small_molecule").alias("target_type"),
    )


def top_targets(df: DataFrame, n: int | None) -> DataFrame:
    """Most frequent names without a protein sequence; ties by name."""
    counts = (
        df.where(F.col("protein_sequence").isNull() & F.col("target_name").isNotNull())
        .groupBy("target_name").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts if n is None else counts.orderBy(F.desc("n"), "target_name").limit(n)


def enrich_fill(
    df: DataFrame, resolved: DataFrame, top: int | None = None, legacy: bool = False
) -> DataFrame:
    """Write id, sequence and source of resolved names.

    legacy: every row of the name; cleaned: only protein rows still missing one.
    """
    gap = df if legacy else df.where(F.col("target_type") == "protein")
    table = top_targets(gap, top).select("target_name").join(
        resolved.select(
            "target_name", F.col("accession").alias("_acc"),
            F.col("protein_sequence").alias("_seq"),
        ),
        "target_name",
    )
    joined = skew.attach(df, table, ["target_name"])
    hit = F.col("_seq").isNotNull()
    if not legacy:
        hit = hit & F.col("protein_sequence").isNull()
    return joined.select(
        *[c for c in df.columns if c not in ("target_id", "target_id_source", "protein_sequence")],
        F.when(hit, F.col("_acc")).otherwise(F.col("target_id")).alias("target_id"),
        F.when(hit, "UniProt").otherwise(F.col("target_id_source")).alias("target_id_source"),
        F.when(hit, F.col("_seq")).otherwise(F.col("protein_sequence")).alias("protein_sequence"),
    )


def apply_patch(df: DataFrame, patch: DataFrame, keys, values) -> DataFrame:
    """Keyed updates, then inserts: patch values win, unknown keys are added.

    The patch must have one row per key; a row with NULL keeps the old value.
    """
    keys = list(keys)
    updates = patch.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values])
    changed = skew.attach(df, updates, keys)
    for v in values:
        changed = changed.withColumn(v, F.coalesce(F.col(f"_new_{v}"), F.col(v)))
    known = df.select(*keys).distinct()
    inserted = patch.join(known, keys, "left_anti")
    return changed.select(*df.columns).unionByName(inserted, allowMissingColumns=True)
