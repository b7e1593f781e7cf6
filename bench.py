"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strandloom import queries  # noqa: E402
from strandloom.queries.derived import derived  # noqa: E402
from strandloom.session import local_session  # noqa: E402

HEADLINE = [
    "clean_share", "clean_phases", "validate_sequence", "exact_dedup", "rc_pair_dedup",
    "dedup_against_master", "merge_stats", "leakage_to_train", "canonical_name", "near_dupe_sequences",
    "connected_components", "budget_assign", "augment_train", "attach_features", "auroc",
    "kmer_tokens_padded", "extract_conditions", "extract_sequences", "records_from_text",
    "records_from_tables", "parse_html_pages", "parse_plain_text", "resolve_exact_fuzzy",
]
INPUTS = [
    "legacy", "records", "recs", "old_splits", "compound_ids", "text_records", "feature_cache",
    "predictions", "sentences", "table_cells", "proteins",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    registered, _ = queries.load()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    t0 = time.time()
    for name in INPUTS:  # derived input tables are written once, like landed data
        derived(spark, sf_dir, name).count()
    prepared = time.time() - t0
    timings = {}
    for name in names:
        t0 = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
        print(f"{name:30s} {timings[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "inputs_prepared_sec": round(prepared, 3),
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
