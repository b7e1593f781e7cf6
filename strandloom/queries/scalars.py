"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions import extract, measure, names, sequence, text
from strandloom.queries.derived import derived, table
from strandloom.queries.registry import query


def _sql_any(expr: str, parts) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{p}')" for p in parts) + ")"


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(
    "reverse_complement",
    "SELECT row_id, reverse(translate(sequence,'ACGTacgt','TGCAtgca')) AS rc FROM legacy",
)
def reverse_complement(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id", sequence.reverse_complement(F.col("sequence")).alias("rc")
    )


@query(
    "clean_sequence",
    """SELECT row_id, nullif(replace(regexp_replace(upper(trim(seq)), '[^ATGCU]', '', 'g'), 'U', 'T'), '')
       AS cleaned FROM assayed""",
)
def clean_sequence(spark, sf):
    return derived(spark, sf, "assayed").select(
        "row_id", sequence.clean_sequence(F.col("seq")).alias("cleaned")
    )


@query(
    "normalise_match",
    """SELECT row_id, replace(upper(replace(replace(seq, ' ', ''), chr(9), '')), 'U', 'T') AS dna,
              upper(replace(replace(seq, ' ', ''), chr(9), '')) AS rna FROM assayed""",
)
def normalise_match(spark, sf):
    return derived(spark, sf, "assayed").select(
        "row_id", sequence.normalise_match(F.col("seq")).alias("dna"),
        sequence.normalise_match(F.col("seq"), rna=True).alias("rna"),
    )


@query(
    "gc_content",
    """SELECT row_id, length(regexp_replace(upper(sequence), '[^GC]', '', 'g')) / length(sequence) AS gc
       FROM legacy""",
)
def gc_content(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id", sequence.gc_content(F.col("sequence")).alias("gc")
    )


@query(
    "homopolymer_flag",
    """SELECT row_id, regexp_matches(sequence, 'A{9,}|T{9,}|G{9,}|C{9,}') AS flag FROM legacy""",
)
def homopolymer_flag(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id", sequence.homopolymer_flag(F.col("sequence")).alias("flag")
    )


@query(
    "kmer_set",
    """SELECT row_id, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT substr(sequence, i, 6) AS k
         FROM (SELECT unnest(range(1, greatest(length(sequence) - 4, 1)))) r(i))) AS kmers FROM legacy""",
)
def kmer_set(spark, sf):
    df = derived(spark, sf, "legacy")
    joined = F.array_join(F.array_sort(sequence.kmer_set(F.col("sequence"), 6)), ",")
    return df.select("row_id", F.nullif(joined, F.lit("")).alias("kmers"))


_TOKEN = """list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: CASE
  WHEN strpos('ACGT', substr(s, i, 1)) > 0 AND strpos('ACGT', substr(s, i + 1, 1)) > 0
    AND strpos('ACGT', substr(s, i + 2, 1)) > 0
  THEN 2 + 16 * (strpos('ACGT', substr(s, i, 1)) - 1) + 4 * (strpos('ACGT', substr(s, i + 1, 1)) - 1)
    + strpos('ACGT', substr(s, i + 2, 1)) - 1 ELSE 1 END)"""


@query(
    "kmer_tokens",
    f"""SELECT row_id, array_to_string({_TOKEN}, ',') AS tokens
        FROM (SELECT row_id, upper(trim(coalesce(sequence, ''))) AS s FROM legacy) x""",
)
def kmer_tokens(spark, sf):
    df = derived(spark, sf, "legacy")
    return df.select(
        "row_id", F.array_join(sequence.kmer_tokens(F.col("sequence")), ",").alias("tokens")
    )


@query(
    "kmer_tokens_padded",
    f"""SELECT row_id, array_to_string(list_resize({_TOKEN}[1:120], 120, 0), ',') AS tokens
        FROM (SELECT row_id, upper(trim(coalesce(sequence, ''))) AS s FROM legacy) x""",
)
def kmer_tokens_padded(spark, sf):
    df = derived(spark, sf, "legacy")
    return df.select(
        "row_id", F.array_join(sequence.kmer_tokens_padded(F.col("sequence")), ",").alias("tokens")
    )


@query(
    "kmer_decode",
    """SELECT row_id, CASE WHEN len(ws) = 0 THEN '' ELSE
           array_to_string(list_transform(ws[1:len(ws) - 1], lambda w: substr(w, 1, 1)), '') || ws[len(ws)] END AS decoded
       FROM (SELECT row_id, list_transform(range(1, least(greatest(length(s) - 2, 0), 120) + 1), lambda i:
               CASE WHEN regexp_full_match(substr(s, i, 3), '[ACGT]{3}') THEN substr(s, i, 3) ELSE '[UNK]' END) AS ws
             FROM (SELECT row_id, upper(trim(coalesce(sequence, ''))) AS s FROM legacy) x) y""",
)
def kmer_decode(spark, sf):
    """All rows, those with unknown bases, too few of them or none too."""
    ids = sequence.kmer_tokens_padded(F.col("sequence"))
    return derived(spark, sf, "legacy").select("row_id", sequence.kmer_decode(ids).alias("decoded"))


@query(
    "bounded_levenshtein",
    """SELECT a.row_id, CAST(least(levenshtein(a.aptamer_sequence, b.aptamer_sequence), 3) AS INTEGER) AS dist
       FROM records a JOIN records b ON b.row_id = a.row_id - a.row_id % 10""",
)
def bounded_levenshtein(spark, sf):
    a = derived(spark, sf, "records").select("row_id", F.col("aptamer_sequence").alias("x"))
    b = a.select(F.col("row_id").alias("lead"), F.col("x").alias("y"))
    paired = a.withColumn("lead", F.col("row_id") - F.col("row_id") % 10).join(b, "lead")
    return paired.select(
        "row_id", sequence.bounded_levenshtein(F.col("x"), F.col("y")).alias("dist")
    )


@query(
    "kd_convert",
    """SELECT row_id, CASE WHEN v < 0 THEN NULL ELSE CASE u WHEN 'pM' THEN v / 1000 WHEN 'nM' THEN v WHEN 'uM' THEN v * 1000
         WHEN 'mM' THEN v * 1000000 END END AS value_nm,
       CASE WHEN v < 0 THEN NULL ELSE CASE u WHEN 'pM' THEN 'pM' WHEN 'nM' THEN 'nM' WHEN 'uM' THEN 'µM' WHEN 'mM' THEN 'mM' END END AS unit,
       CASE WHEN v < 0 THEN 'negative value' WHEN u = 'kg' THEN 'unrecognised unit' END AS error
       FROM (SELECT row_id, CAST(row_id % 900 - 20 AS DOUBLE) AS v,
         split_part('pM|nM|uM|mM|kg', '|', CAST(row_id % 5 + 1 AS INT)) AS u FROM records) x""",
)
def kd_convert(spark, sf):
    df = derived(spark, sf, "records")
    unit = F.split_part(F.lit("pM|nM|uM|mM|kg"), F.lit("|"), (F.col("row_id") % 5 + 1).cast("int"))
    kd = measure.kd_convert((F.col("row_id") % 900 - 20).cast("double"), unit)
    return df.select("row_id", kd.alias("k")).select(
        "row_id", F.col("k.value_nM").alias("value_nm"), F.col("k.canonical_unit").alias("unit"),
        F.col("k.error").alias("error"),
    )


@query(
    "kd_parse",
    """SELECT row_id, CASE WHEN row_id % 7 = 0 THEN NULL ELSE n * (CASE row_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 ELSE 1000000.0 END)::DOUBLE END AS value_nm,
       CASE WHEN row_id % 7 = 0 THEN NULL ELSE (CASE row_id % 3 WHEN 0 THEN 'nM' WHEN 1 THEN 'µM' ELSE 'mM' END) END AS unit
       FROM (SELECT row_id, CAST(row_id % 900 + 1 AS DOUBLE) AS n FROM records) x""",
)
def kd_parse(spark, sf):
    unit = F.split_part(F.lit(" NM | uM|mm"), F.lit("|"), (F.col("row_id") % 3 + 1).cast("int"))
    prefix = F.when(F.col("row_id") % 7 == 0, "Kd ").otherwise(" ")
    raw = F.concat(prefix, (F.col("row_id") % 900 + 1).cast("string"), unit)
    return derived(spark, sf, "records").select("row_id", measure.kd_parse(raw).alias("k")).select(
        "row_id", F.col("k.value_nM").alias("value_nm"), F.col("k.unit").alias("unit")
    )


@query(
    "kd_cell_parse",
    """SELECT row_id, CASE row_id % 5 WHEN 0 THEN n WHEN 1 THEN n * 1000 WHEN 2 THEN n WHEN 3 THEN n * 1000 END AS value_nm,
       CASE row_id % 5 WHEN 0 THEN 'nM' WHEN 1 THEN 'uM' WHEN 3 THEN 'uM' END AS unit
       FROM (SELECT row_id, CAST(row_id % 900 + 1 AS DOUBLE) AS n FROM records) x""",
)
def kd_cell_parse(spark, sf):
    n = (F.col("row_id") % 900 + 1).cast("string")
    kind = F.col("row_id") % 5
    cell = (
        F.when(kind == 0, F.concat(F.lit("> "), n, F.lit(" ± 3 nM")))
        .when(kind == 1, F.concat(n, F.lit("uM")))
        .when(kind.isin(2, 3), n).otherwise("n.d.")
    )
    header = F.when(kind == 3, "Kd (uM)").otherwise("Affinity")
    return derived(spark, sf, "records").select(
        "row_id", measure.kd_cell_parse(cell, header).alias("k")
    ).select("row_id", F.col("k.value_nM").alias("value_nm"), F.col("k.unit").alias("unit"))


@query(
    "strip_noise",
    f"""SELECT p_partkey, coalesce((SELECT string_agg(t, ' ' ORDER BY i) FROM (SELECT unnest(toks) AS t, generate_subscripts(toks, 1) AS i) z
          WHERE length(t) > 1 AND t NOT IN ({_sql_list(fv.NOISE_WORDS)})), '') AS cleaned
        FROM (SELECT p_partkey, regexp_extract_all(lower(concat('Human ', p_name, ' of the ', p_brand, ' HIS-tagged a')), '\\b[\\w-]+\\b') AS toks FROM part) x""",
)
def strip_noise(spark, sf):
    raw = F.concat(F.lit("Human "), "p_name", F.lit(" of the "), "p_brand", F.lit(" HIS-tagged a"))
    return table(spark, sf, "part").select("p_partkey", names.strip_noise(raw).alias("cleaned"))


@query(
    "token_overlap",
    """SELECT p_partkey, len(list_intersect(q, r)) / len(list_distinct(q)) AS score FROM (
         SELECT p_partkey, regexp_extract_all(lower(concat(p_name, ' ', p_type)), '\\b\\w+\\b') AS q,
                regexp_extract_all(lower(concat(p_type, ' red ', p_brand)), '\\b\\w+\\b') AS r FROM part) x""",
)
def token_overlap(spark, sf):
    q = F.concat("p_name", F.lit(" "), "p_type")
    r = F.concat("p_type", F.lit(" red "), "p_brand")
    return table(spark, sf, "part").select("p_partkey", names.token_overlap(q, r).alias("score"))


@query(
    "deep_norm",
    """SELECT row_id, CASE WHEN target_protein IS NOT NULL THEN trim(regexp_replace(lower(concat(' ', target_protein, chr(9), '  x', chr(160), 'y ')), '[\\s\\x{a0}]+', ' ', 'g')) END AS norm
       FROM legacy""",
)
def deep_norm(spark, sf):
    raw = F.concat(F.lit(" "), "target_protein", F.lit("\t  x y "))
    return derived(spark, sf, "legacy").select(
        "row_id", names.deep_norm(raw).alias("norm")
    )


@query(
    "pmid_from_url",
    """SELECT row_id, CASE WHEN row_id % 7 <> 0 THEN CAST(1000 + row_id AS VARCHAR) END AS pmid FROM assayed""",
)
def pmid_from_url(spark, sf):
    return derived(spark, sf, "assayed").select(
        "row_id", names.pmid_from_url(F.col("link")).alias("pmid")
    )


@query(
    "pmid_prefix",
    """SELECT row_id, nullif(regexp_extract(trim(aptamer_id), '^([0-9]+)', 1), '') AS pmid FROM pairlist""",
)
def pmid_prefix(spark, sf):
    return derived(spark, sf, "pairlist").select(
        "row_id", names.pmid_prefix(F.col("aptamer_id")).alias("pmid")
    )


@query(
    "stem_loop_count",
    """SELECT row_id, CAST(len(regexp_extract_all(d, '\\(+')) AS INTEGER) AS stems,
              CAST(len(regexp_extract_all(d, '\\(\\.*\\)')) AS INTEGER) AS loops
       FROM (SELECT row_id, translate(aptamer_sequence, 'ACGT', '(.).') AS d FROM records) x""",
)
def stem_loop_count(spark, sf):
    d = F.translate("aptamer_sequence", "ACGT", "(.).")
    return derived(spark, sf, "records").select(
        "row_id", sequence.stem_count(d).alias("stems"), sequence.loop_count(d).alias("loops")
    )


@query(
    "text_context",
    """SELECT doc_id, concat(CASE WHEN lo > 0 THEN '…' ELSE '' END, substr(text, lo + 1, hi - lo),
              CASE WHEN hi < n THEN '…' ELSE '' END) AS context
       FROM (SELECT doc_id, text, length(text) AS n, greatest(length(text) // 2 - 200, 0) AS lo,
               least(length(text) // 2 + 10 + 200, length(text)) AS hi FROM documents) x""",
)
def text_context(spark, sf):
    mid = F.floor(F.length("text") / 2)
    return table(spark, sf, "documents").select(
        "doc_id", text.text_context(F.col("text"), mid, mid + 10).alias("context")
    )


@query(
    "md5_key",
    "SELECT row_id, md5('1024:' || protein_sequence) AS key FROM records",
)
def md5_key(spark, sf):
    return derived(spark, sf, "records").select(
        "row_id", sequence.md5_key(F.col("protein_sequence")).alias("key")
    )


@query("utc_stamp", "SELECT source, count(*) AS n, TRUE AS well_formed, TRUE AS recent FROM documents GROUP BY 1")
def utc_stamp(spark, sf):
    """The stamp differs from run to run; its form and age are checked."""
    stamped = table(spark, sf, "documents").withColumn("at", text.utc_stamp())
    age = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(
        F.to_timestamp("at", "yyyy-MM-dd'T'HH:mm:ssX")))
    return stamped.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).alias("well_formed"),
        F.bool_and(age < 3600).alias("recent"),
    )


@query(
    "truncations",
    """SELECT row_id, m AS method, CASE m WHEN 'trunc_L2' THEN substr(s, 3) WHEN 'trunc_L3' THEN substr(s, 4)
         WHEN 'trunc_R2' THEN substr(s, 1, length(s) - 2) ELSE substr(s, 1, length(s) - 3) END AS cut
       FROM (SELECT row_id, aptamer_sequence AS s, unnest(['trunc_L2','trunc_R2','trunc_L3','trunc_R3']) AS m FROM records) x""",
)
def truncations(spark, sf):
    df = derived(spark, sf, "records")
    return df.select(
        "row_id", F.explode(sequence.truncations(F.col("aptamer_sequence"))).alias("t")
    ).select("row_id", F.col("t.method").alias("method"), F.col("t.sequence").alias("cut"))


@query(
    "scramble",
    """SELECT row_id, string_agg(b, '' ORDER BY o, b) AS scrambled FROM (
         SELECT row_id, substr(aptamer_sequence, CAST(i AS INT), 1) AS b, md5(concat('42|', row_id, '|', i)) AS o
         FROM (SELECT row_id, aptamer_sequence, unnest(range(1, length(aptamer_sequence) + 1)) AS i FROM recs) x) y
       GROUP BY row_id""",
)
def scramble(spark, sf):
    return derived(spark, sf, "recs").select(
        "row_id", sequence.scramble(F.col("aptamer_sequence"), F.col("row_id")).alias("scrambled")
    )


# --- predicates -------------------------------------------------------------


@query(
    "is_augment_valid",
    """SELECT row_id, coalesce(length(sequence) BETWEEN 20 AND 120 AND regexp_full_match(upper(sequence), '[ATGC]+')
         AND length(regexp_replace(upper(sequence), '[^GC]', '', 'g')) / length(sequence) BETWEEN 0.2 AND 0.8, false) AS ok FROM legacy""",
)
def is_augment_valid(spark, sf):
    ok = F.coalesce(sequence.is_augment_valid(F.col("sequence")), F.lit(False))
    return derived(spark, sf, "legacy").select("row_id", ok.alias("ok"))


@query(
    "nucleic_acid_type",
    """SELECT row_id, CASE WHEN sequence IS NULL THEN 'unknown' WHEN contains(upper(sequence), 'U') THEN 'ssRNA'
         WHEN regexp_full_match(sequence, '[ATGCatgc]+') THEN 'ssDNA' ELSE 'other' END AS kind FROM legacy""",
)
def nucleic_acid_type(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id", sequence.nucleic_acid_type(F.col("sequence")).alias("kind")
    )


_FAULT = """CASE WHEN length(s) < 20 THEN concat('too_short (', length(s), ' < 20)')
  WHEN length(s) > 120 THEN concat('too_long (', length(s), ' > 120)')
  WHEN regexp_matches(s, '[^AUGC]') THEN concat('invalid_bases (', array_to_string(list_sort(list_distinct(string_split(regexp_replace(s, '[AUGC]', '', 'g'), ''))), ','), ')')
  WHEN gc < 0.2 THEN concat('gc_too_low (', printf('%.2f', gc), ' < 0.2)')
  WHEN gc > 0.8 THEN concat('gc_too_high (', printf('%.2f', gc), ' > 0.8)')
  WHEN regexp_matches(s, 'A{9,}|U{9,}|G{9,}|C{9,}') THEN 'homopolymer_run (>8 identical bases)' ELSE '' END"""


@query(
    "validate_rna",
    f"""SELECT row_id, CASE WHEN s IS NULL THEN 'not_a_string' ELSE {_FAULT} END AS fault FROM (SELECT row_id, s, length(regexp_replace(s, '[^GC]', '', 'g')) / length(s) AS gc
        FROM (SELECT row_id, replace(upper(trim(sequence)), 'T', 'U') AS s FROM legacy) x) y""",
)
def validate_rna(spark, sf):
    rna = F.translate(F.upper(F.trim("sequence")), "T", "U")
    return derived(spark, sf, "legacy").select(
        "row_id", sequence.rna_fault(rna).alias("fault")
    )


@query(
    "keyword_gate",
    """SELECT doc_id, regexp_matches(text, '\\baptamer\\b|\\bSELEX\\b', 'i') AS works,
         regexp_matches(text, '\\baptamer\\b|\\bSELEX\\b|\\bDNA\\s+binding\\b|\\bRNA\\s+aptamer\\b', 'i') AS preprint,
         regexp_matches(text, '\\baptamer\\b|\\bSELEX\\b|\\bssDNA\\b', 'i') AS patent FROM sentences""",
)
def keyword_gate(spark, sf):
    c = F.col("text")
    return derived(spark, sf, "sentences").select(
        "doc_id", text.keyword_gate(c, fv.GATE_WORKS).alias("works"),
        text.keyword_gate(c, fv.GATE_PREPRINT).alias("preprint"),
        text.keyword_gate(c, fv.GATE_PATENT).alias("patent"),
    )


_NP = "|".join(p.replace("(?!-binding)", "") for p in fv.NON_PROTEIN_PATTERNS)


@query(
    "is_non_protein",
    f"""SELECT row_id, coalesce(CASE WHEN lower(trim(n)) IN ({_sql_list(fv.NON_PROTEIN_EXCEPTIONS)}) THEN false
          WHEN contains(lower(n), 'gtp-binding') THEN false
          ELSE regexp_matches(n, '{_NP}', 'i') END, false) AS flag FROM (SELECT row_id, target_protein AS n FROM legacy) x""",
)
def is_non_protein(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id", names.is_non_protein(F.col("target_protein")).alias("flag")
    )


@query(
    "classify_target_clean",
    f"""SELECT row_id, CASE WHEN length(p) > 10 THEN 'protein' WHEN n IS NULL OR trim(n) = '' THEN 'other'
          WHEN {_sql_any('l', fv.GARBAGE_PHRASES)} OR l = 'unknown' THEN 'other'
          WHEN l IN ({_sql_list(fv.SMALL_MOLECULES)}) OR {_sql_any('l', fv.SMALL_MOLECULE_PARTS)} THEN 'small_molecule'
          WHEN {_sql_any('l', fv.ION_PARTS)} THEN 'ion' WHEN {_sql_any('l', fv.CELL_PARTS)} THEN 'cell'
          WHEN {_sql_any('l', fv.ORGANISM_PARTS)} THEN 'organism' ELSE 'protein' END AS kind
        FROM (SELECT row_id, target_protein AS n, lower(trim(target_protein)) AS l, protein_sequence AS p FROM legacy) x""",
)
def classify_target_clean(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id",
        names.classify_clean(F.col("target_protein"), F.col("protein_sequence")).alias("kind"),
    )


@query(
    "classify_target_rules",
    "SELECT row_id, CASE WHEN n IS NULL OR trim(n) = '' THEN 'other' "
    + " ".join(f"WHEN regexp_matches(n, '{p}', 'i') THEN '{k}'" for k, p in fv.TARGET_TYPE_PATTERNS)
    + " ELSE 'protein' END AS kind FROM (SELECT row_id, target_protein AS n FROM legacy) x",
)
def classify_target_rules(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id", names.classify_rules(F.col("target_protein")).alias("kind")
    )


@query(
    "reclassify_non_protein",
    "SELECT row_id, CASE "
    + " ".join(f"WHEN {_sql_any('n', ps)} THEN '{k}'" for k, ps in fv.RECLASSIFY_PARTS)
    + " ELSE 'small_molecule' END AS kind FROM (SELECT row_id, lower(target_protein) AS n FROM legacy) x",
)
def reclassify_non_protein(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id", names.reclassify(F.col("target_protein")).alias("kind")
    )


# --- projections ------------------------------------------------------------


@query(
    "format_source_id",
    """SELECT row_id, CASE row_id % 6 WHEN 0 THEN concat('PMID:', 10000000 + row_id) WHEN 1 THEN source_pmid
         WHEN 2 THEN concat('10.1000/y', row_id) WHEN 3 THEN source_pmid WHEN 4 THEN concat('PMID:', 20000000 + row_id) END AS source_doi FROM legacy""",
)
def format_source_id(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id", names.format_source_id(F.col("source_pmid"), F.col("source")).alias("source_doi")
    )


@query(
    "confidence_rule",
    f"""SELECT row_id, CASE WHEN {_sql_any('lower(target_protein)', fv.UNCERTAIN_PHRASES)} THEN 'uncertain'
          WHEN source = 'li2014' THEN 'extracted' WHEN source = 'utexas' AND Kd_nM IS NOT NULL THEN 'curated'
          WHEN source IN ('utexas','aptamerbase','pubmed') THEN 'extracted' ELSE 'non-curated' END AS score FROM legacy""",
)
def confidence_rule(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id",
        names.confidence(F.col("source"), F.col("target_protein"), F.col("Kd_nM")).alias("score"),
    )


@query(
    "buffer_code",
    """SELECT row_id, CAST(CASE WHEN buf IS NULL THEN 0 WHEN contains(lower(buf), 'pbs') OR contains(lower(buf), 'phosphate') THEN 0
         WHEN contains(lower(buf), 'hepes') THEN 1 WHEN contains(lower(buf), 'tris') THEN 2 ELSE 3 END AS INTEGER) AS code FROM assayed""",
)
def buffer_code(spark, sf):
    return derived(spark, sf, "assayed").select(
        "row_id", measure.buffer_code(F.col("buf")).alias("code")
    )


@query(
    "condition_vector",
    """SELECT row_id, coalesce(ph, 7.4) AS c1, coalesce(na_concentration_mM, 150.0) AS c2, coalesce(temperature_C, 37.0) AS c3,
         0.0::DOUBLE AS c4, coalesce(mg_concentration_mM, 2.0) AS c5 FROM records""",
)
def condition_vector(spark, sf):
    v = measure.condition_vector(
        F.col("ph"), F.col("na_concentration_mM"), F.col("temperature_C"), F.col("mg_concentration_mM")
    )
    return derived(spark, sf, "records").select("row_id", v.alias("v")).select(
        "row_id", *[F.get("v", F.lit(i)).alias(f"c{i + 1}") for i in range(5)]
    )


@query(
    "kd_log_target",
    """SELECT row_id, round(CASE WHEN kd_value >= 0 THEN log10(kd_value + 1) END, 9) AS kd_log FROM records""",
)
def kd_log_target(spark, sf):
    return derived(spark, sf, "records").select(
        "row_id", F.round(measure.kd_log(F.col("kd_value")), 9).alias("kd_log")
    )


@query(
    "assign_tier",
    f"""SELECT row_id, CAST(CASE WHEN {_sql_any('lower(target_protein)', fv.VALIDATION_TARGETS)} THEN 2 ELSE 1 END AS INTEGER) AS tier FROM legacy""",
)
def assign_tier(spark, sf):
    return derived(spark, sf, "legacy").select(
        "row_id", names.assign_tier(F.col("target_protein")).alias("tier")
    )


@query(
    "qualify_binding",
    """SELECT row_id, CAST(CASE WHEN kd_pred IS NOT NULL THEN CASE WHEN kd_pred < log10(11) THEN 2 WHEN kd_pred < log10(1001) THEN 1 ELSE 0 END
         ELSE CASE WHEN y_prob > 0.66 THEN 2 WHEN y_prob > 0.33 THEN 1 ELSE 0 END END AS INTEGER) AS grade FROM predictions""",
)
def qualify_binding(spark, sf):
    return derived(spark, sf, "predictions").select(
        "row_id", measure.qualify(F.col("y_prob"), F.col("kd_pred")).alias("grade")
    )


# --- text -------------------------------------------------------------------


@query(
    "parse_plain_text",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS text
       FROM documents""",
)
def parse_plain_text(spark, sf):
    from strandloom.sources.documents import parse_text

    return parse_text(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "garble_filter",
    """SELECT doc_id, len(w) >= 20 AND len(list_filter(w, lambda x: length(x) = 1)) / len(w) > 0.3 AS garbled
       FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '(.)[^\\s]*', CASE WHEN doc_id % 2 = 0 THEN '\\1' ELSE '\\0' END, 'g'), '\\s+'), lambda x: x <> '') AS w
             FROM documents) y""",
)
def garble_filter(spark, sf):
    # every second document is cut to first letters, so both outcomes occur
    mixed = F.when(
        F.col("doc_id") % 2 == 0, F.regexp_replace("text", r"([^\n])\S*", "$1")
    ).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.looks_garbled(mixed).alias("garbled"))


@query(
    "extract_assay",
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(text, '{p}', 'i') THEN '{k}'" for k, p in fv.ASSAY_PATTERNS)
    + " ELSE '' END AS assay FROM sentences",
)
def extract_assay(spark, sf):
    return derived(spark, sf, "sentences").select(
        "doc_id", extract.extract_assay(F.col("text")).alias("assay")
    )


@query(
    "guess_target",
    """SELECT doc_id, CASE WHEN length(p) > 3 AND length(p) < 80 THEN p
         ELSE coalesce(nullif(regexp_extract(text, '"""
    + fv.KNOWN_TARGETS
    + """', 1, 'i'), ''), 'unknown') END AS target
       FROM (SELECT doc_id, text, trim(regexp_extract(text, '"""
    + fv.TARGET_PHRASE
    + """', 1, 'i')) AS p FROM sentences) x""",
)
def guess_target(spark, sf):
    return derived(spark, sf, "sentences").select(
        "doc_id", extract.guess_target(F.col("text")).alias("target")
    )


def _num(pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(text, '{pattern}', 1, 'i'), '') AS DOUBLE)"


_BUFFER = "CASE " + " ".join(
    f"WHEN regexp_matches(s, '{p}', 'i') THEN '{k}'" for k, p in fv.BUFFER_PATTERNS
) + " END"


@query(
    "extract_conditions",
    f"""WITH sent AS (SELECT doc_id, i, {_BUFFER} AS buf, regexp_matches(s, '{fv.SELECTION_BUFFER}', 'i') AS sel,
           regexp_matches(s, '{fv.BINDING_BUFFER}', 'i') AS bind FROM
           (SELECT doc_id, unnest(string_split_regex(text, '[.!?;]\\s+')) AS s,
              generate_subscripts(string_split_regex(text, '[.!?;]\\s+'), 1) AS i FROM sentences) x),
        per AS (SELECT doc_id, arg_min(buf, i) AS any_buf, arg_min(buf, i) FILTER (sel) AS s_buf, arg_min(buf, i) FILTER (bind) AS b_buf,
           string_agg(buf, ',' ORDER BY i) AS bufs FROM sent WHERE buf IS NOT NULL GROUP BY doc_id)
        SELECT s.doc_id, CASE WHEN {_num(fv.PH_TEXT)} BETWEEN 0 AND 14 THEN {_num(fv.PH_TEXT)} END AS ph,
          coalesce({_num(fv.NA_TEXT)}, {_num(fv.IONIC_TEXT)}) AS na, {_num(fv.MG_TEXT)} AS mg,
          CASE WHEN {_num(fv.TEMP_TEXT)} BETWEEN 0 AND 100 THEN {_num(fv.TEMP_TEXT)} END AS temperature,
          CASE WHEN s_buf IS NULL AND b_buf IS NULL THEN any_buf ELSE s_buf END AS selection_buffer,
          CASE WHEN s_buf IS NULL AND b_buf IS NULL THEN any_buf ELSE b_buf END AS binding_buffer
        FROM sentences s LEFT JOIN per ON per.doc_id = s.doc_id""",
)
def extract_conditions(spark, sf):
    return derived(spark, sf, "sentences").select(
        "doc_id", "text"
    ).transform(extract.with_conditions).select(
        "doc_id", "c.ph", "c.na", "c.mg", "c.temperature", "c.selection_buffer", "c.binding_buffer"
    )


@query(
    "extract_kd_native",
    """SELECT doc_id, round(v * CASE u WHEN 'nm' THEN 1.0 WHEN 'pm' THEN 0.001 WHEN 'um' THEN 1000.0 WHEN 'mm' THEN 1000000.0 END, 6)::DOUBLE AS kd_nm
       FROM (SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '"""
    + fv.KD_TEXT
    + """', 1, 'i'), '') AS DOUBLE) AS v, lower(regexp_extract(text, '"""
    + fv.KD_TEXT
    + """', 2, 'i')) AS u FROM sentences) x""",
)
def extract_kd_native(spark, sf):
    return derived(spark, sf, "sentences").select(
        "doc_id", F.round(F.get(extract.kd_values_native(F.col("text")), F.lit(0)), 6).alias("kd_nm")
    )
