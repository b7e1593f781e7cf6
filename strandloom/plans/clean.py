"""The cleaning phases end to end: legacy rows in, cleaned rows, side tables and audits out.

Phases decide on a narrow table: ids, sequence, target and a few short columns.  What
they decide, (row_id, split, classes, ids), is written in buckets of ``row_id``, as are the legacy rows
once; so the last step joins them without a shuffle, and no phase rewrites a row.  Rows are written in full
twice: in buckets at the start, and by whoever writes the result.  Side tables (review queue, removed rows, audits)
are derived frames, never driver lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import names
from strandloom.operators import audit, dedup, enrich, mapping, skew, validate
from strandloom.session import bucketed, durable
from strandloom.sources.sinks import phase_snapshot


@dataclass
class Cleaned:
    rows: DataFrame
    review: DataFrame
    removed: DataFrame
    coverage: DataFrame  # rows per priority target and split before the repair
    leak_targets: DataFrame  # train targets of the sequences that were in several splits
    checks: DataFrame  # issues of the result


def review_queue(*parts: DataFrame) -> DataFrame:
    """Flagged rows of all phases as one table with phase and reason."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _narrow(legacy: DataFrame) -> DataFrame:
    """The columns on which the phases decide."""
    return legacy.select(
        "row_id", "sequence", "target_protein", "uniprot_id", "Kd_nM",
        F.length("protein_sequence").alias("protein_size"),
        names.classify_clean(F.col("target_protein"), F.col("protein_sequence")).alias("target_type"),
    )


def _flagged(complements: DataFrame, moved: DataFrame, misses: DataFrame | None) -> DataFrame:
    parts = [
        complements.select("phase", "reason", "row_id", F.col("sequence"), F.col("target_protein").alias("target_name")),
        moved.select("phase", "reason", "row_id", F.col("aptamer_sequence").alias("sequence"), "target_name"),
    ]
    if misses is not None:
        parts.append(misses.select("phase", "reason", "target_name"))
    return review_queue(*parts)


def review(legacy: DataFrame, splits: DataFrame, compounds: DataFrame | None = None) -> DataFrame:
    """The review queue of ``clean`` alone, without what only the cleaned rows need.

    The legacy rows are not written in buckets and phases 3 to 6 write nothing.  Phase 3 changes splits only, so the
    names of phase 5 are those of the rows of phase 1 that phase 4 keeps.
    """
    narrow = _narrow(legacy).select("row_id", "sequence", "target_protein", "target_type")
    marked = durable(dedup.rc_marked(durable(dedup.exact_dedup(narrow)), flag="_gone"))
    kept = marked.where(~F.col("_gone")).drop("_gone")
    rows = durable(enrich.assign_existing(kept.drop("target_type"), splits))
    named = rows.withColumnsRenamed({"sequence": "aptamer_sequence", "target_protein": "target_name"})
    misses = None
    if compounds is not None:
        misses = enrich.unresolved_compounds(
            validate.quarantine(kept)[0].withColumnRenamed("target_protein", "target_name"), compounds
        )
    return _flagged(dedup.rc_audit(marked, "_gone"), audit.leakage_moves(named)[1], misses)


def _donors(decided: DataFrame, base: DataFrame) -> DataFrame:
    """(target_id, _found, _rows): the protein of the first row of an id that has one, and how many rows lack it."""
    gap, usable = F.coalesce("protein_size", F.lit(0)) == 0, F.col("protein_size") > 10
    firsts = decided.where(F.col("target_id").isNotNull()).groupBy("target_id").agg(
        F.min(F.when(usable, F.col("row_id"))).alias("row_id"), F.count_if(gap).alias("_rows")
    ).where("row_id IS NOT NULL")
    return firsts.join(base.select("row_id", F.col("protein_sequence").alias("_found")), "row_id").select(
        "target_id", "_found", "_rows"
    )


def clean(
    legacy: DataFrame,
    splits: DataFrame,
    compounds: DataFrame | None = None,
    curated: DataFrame | None = None,
    snapshots: str | None = None,
) -> Cleaned:
    """legacy: row_id + legacy columns; splits: sequence, target_protein, split,
    augmented; compounds: name, cid; curated: row_id + record columns.

    Curated rows are in the result with their own row_id.  ``snapshots`` names a folder for the narrow tables of
    phases 1, 3 and 5."""
    keep = (lambda df, n: phase_snapshot(df, snapshots, n)) if snapshots else (lambda df, n: durable(df))

    base = bucketed(legacy)
    # 1: exact and complement copies; 2: audit of the older splits
    unique = durable(dedup.exact_dedup(_narrow(base)))
    rows, complements = dedup.rc_dedup(unique)
    rows = keep(enrich.assign_existing(rows, splits), 1)
    named = rows.withColumnsRenamed({"sequence": "aptamer_sequence", "target_protein": "target_name"})
    coverage = audit.coverage_audit(named.withColumnRenamed("Kd_nM", "kd_value"))
    # 3: leaks go to train
    repaired, moved, leak_targets = audit.leakage_moves(named)
    rows = keep(repaired.withColumnsRenamed({"aptamer_sequence": "sequence", "target_name": "target_protein"}), 3)
    # 4: other molecules and lengths go
    rows, removed = validate.quarantine(rows)
    removed = base.join(removed.select("row_id", "split", "nucleic_acid_type", "removal_reason"), "row_id")
    # 5: classes and ids
    typed = mapping.clear_wrong_ids(rows)
    misses = None
    if compounds is not None:
        typed, misses = enrich.resolve_compounds(typed.withColumnRenamed("target_protein", "target_name"), compounds)
        typed = typed.withColumnRenamed("target_name", "target_protein")
    decided = keep(typed, 5)
    verdicts = bucketed(decided.select("row_id", "split", "nucleic_acid_type", "target_type", "target_id", "target_id_source"))
    # 6: proteins by id and curated rows
    donors = durable(_donors(decided, base))
    gaps = decided.where((F.coalesce("protein_size", F.lit(0)) == 0) & F.col("target_id").isNotNull()).select("row_id", "target_id")
    fills = bucketed(skew.spread_join(gaps, donors, ["target_id"], "_rows", how="inner").select("row_id", "_found"))
    full = base.join(verdicts, "row_id").join(fills, "row_id", "left").withColumn(
        "protein_sequence", F.coalesce("_found", "protein_sequence")
    )
    out = mapping.to_cleaned(full.withColumn("modifications", F.lit("none")))
    if curated is not None:
        known = decided.select(F.col("sequence").alias("aptamer_sequence"), F.col("target_protein").alias("target_name"))
        new = skew.attach(enrich.curated_new(curated, known, out.schema), donors.select("target_id", "_found"), ["target_id"])
        out = out.unionByName(new.withColumn("protein_sequence", F.col("_found")).drop("_found"), allowMissingColumns=True)
    # 7: audit of the result
    out = validate.downgrade_bad_sequences(out)

    return Cleaned(
        out, _flagged(complements, moved, misses), removed, coverage, leak_targets, validate.export_audit(out)
    )
