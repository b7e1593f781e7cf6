"""Input frames derived from the shared tables.

The shared tables hold no nucleotide sequences, so records, interactions,
landed documents and predictions are derived from ``part``, ``orders`` and
``lineitem`` by plain SQL.  The same text runs in Spark and in the checking
engine; ``@name@`` stands for a shared table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

NAMES = (
    "Thrombin|thrombin|human serum albumin|Insulin|NT-proBNP|Troponin I|Myoglobin|Lysozyme|"
    "streptavidin|VEGF|cocaine|ochratoxin A|HeLa cell line|mercury ion|Salmonella enterica|"
    "nucleolin|malachite green|insulin B chain|GTP-binding protein|GTP|ATP|"
    "the target by claim|unknown|adenosine triphosphate"
)


def _name(index: str) -> str:
    return f"SPLIT_PART('{NAMES}', '|', CAST(({index}) % 24 + 1 AS INT))"


def _bases(key: str) -> str:
    parts = ",".join(f"MD5(CONCAT('{c}',CAST({key} AS STRING)))" for c in "stuv")
    return (
        f"SUBSTR(TRANSLATE(CONCAT({parts}),'0123456789abcdef','ACGTACGTACGTACGT'),1,"
        f"CAST(20 + {key} % 101 AS INT))"
    )


_EDITED = (
    "CASE id % 10 WHEN 1 THEN CONCAT(SUBSTR(s,1,4), CASE SUBSTR(s,5,1) WHEN 'A' THEN 'C' ELSE 'A' END,"
    " SUBSTR(s,6)) WHEN 3 THEN REVERSE(TRANSLATE(s,'ACGT','TGCA')) ELSE s END"
)
_SPLIT = (
    "CASE WHEN id % 20 = 0 THEN 'test' WHEN id % 20 = 5 THEN 'val' WHEN id % 20 < 12 THEN 'train'"
    " ELSE 'unassigned' END"
)


def _base(table: str, key: str, price: str) -> str:
    return f"""
  SELECT id, price, src, {_bases('src')} AS s,
    CASE WHEN id % 10 = 2 AND id % 20 < 10 THEN {_name('src')} ELSE {_name('id')} END AS nm
  FROM (SELECT {key} AS id, {price} AS price,
    CASE WHEN {key} % 10 IN (1,2,3) THEN {key} - {key} % 10 ELSE {key} END AS src FROM @{table}@) t0"""


def _records(base: str) -> str:
    return f"""
  SELECT id AS row_id, {_EDITED} AS aptamer_sequence,
    CASE WHEN id % 7 = 0 THEN UPPER(nm) ELSE nm END AS target_name,
    CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS label,
    CASE WHEN id % 4 = 0 THEN NULL ELSE price END AS kd_value,
    CASE WHEN id % 4 = 0 THEN NULL ELSE 'nM' END AS kd_unit,
    {_SPLIT} AS split,
    CAST(CASE WHEN id % 13 = 0 THEN 2 ELSE 1 END AS INT) AS training_tier,
    CASE WHEN id % 5 = 0 THEN NULL ELSE CONCAT('MKV', UPPER(MD5(CONCAT('p', nm)))) END AS protein_sequence,
    CASE WHEN id % 11 = 0 THEN 'small_molecule' ELSE 'protein' END AS target_type,
    CASE WHEN id % 6 = 0 THEN NULL ELSE CONCAT('P', UPPER(SUBSTR(MD5(nm),1,5))) END AS target_id,
    'UniProt' AS target_id_source,
    CASE WHEN id % 8 = 0 THEN NULL ELSE CAST(6 + id % 3 AS DOUBLE) END AS ph,
    CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(50 + id % 100 AS DOUBLE) END AS na_concentration_mM,
    CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id % 6 AS DOUBLE) END AS mg_concentration_mM,
    CASE WHEN id % 12 = 0 THEN NULL ELSE CAST(20 + id % 20 AS DOUBLE) END AS temperature_C,
    CASE WHEN id % 14 = 0 THEN NULL ELSE 'HEPES' END AS binding_buffer
  FROM {base}"""


_LEGACY = f"""
  SELECT id AS row_id,
    CASE WHEN id % 9 = 4 THEN LOWER(e) ELSE e END AS sequence,
    CASE WHEN id % 41 = 40 THEN NULL WHEN id % 7 = 0 THEN UPPER(nm) ELSE nm END AS target_protein,
    CASE WHEN id % 6 = 0 THEN NULL ELSE CONCAT('P', UPPER(SUBSTR(MD5(nm),1,5))) END AS uniprot_id,
    CASE WHEN id % 3 = 0 THEN NULL ELSE CONCAT('MKV', UPPER(MD5(CONCAT('p', nm)))) END AS protein_sequence,
    CASE WHEN id % 4 = 0 THEN NULL ELSE price END AS Kd_nM,
    CAST(6 + id % 3 AS DOUBLE) AS pH, CAST(50 + id % 100 AS DOUBLE) AS salt_mM,
    CAST(20 + id % 20 AS DOUBLE) AS temp_C, CAST(id % 4 AS INT) AS buffer_type,
    CAST(id % 6 AS DOUBLE) AS mg_mM,
    CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS label,
    CASE id % 6 WHEN 0 THEN CAST(10000000 + id AS STRING) WHEN 1 THEN CONCAT('10.1000/x', CAST(id AS STRING))
      WHEN 2 THEN CONCAT('https://doi.org/10.1000/y', CAST(id AS STRING))
      WHEN 3 THEN CONCAT('US', CAST(id AS STRING), 'B2') WHEN 4 THEN CONCAT(CAST(20000000 + id AS STRING), '.0')
      ELSE NULL END AS source_pmid,
    CAST(CASE WHEN id % 13 = 0 THEN 2 ELSE 1 END AS INT) AS training_tier,
    FALSE AS augmented, CAST(NULL AS STRING) AS aug_method,
    CASE WHEN id % 50 = 19 THEN TRUE ELSE FALSE END AS needs_sequence_enrichment,
    SPLIT_PART('li2014|utexas|aptamerbase|pubmed|patent|biorxiv|database|other', '|', CAST(id % 8 + 1 AS INT)) AS source
  FROM (SELECT *, CASE id % 50
      WHEN 7 THEN TRANSLATE(s,'T','U') WHEN 17 THEN SUBSTR(s,1,12)
      WHEN 27 THEN CONCAT(SUBSTR(s,1,10),'N',SUBSTR(s,11)) WHEN 37 THEN CONCAT(s,s,s,s,s,s,s)
      WHEN 47 THEN CONCAT(SUBSTR(s,1,15),'AAAAAAAAAA',SUBSTR(s,16))
      WHEN 9 THEN CONCAT('ATATATATATGCATATATATAT', SUBSTR('ATATATATATATATATATATATATAT',1,CAST(id % 23 AS INT)))
      WHEN 29 THEN CONCAT('GCGCGCGCGCATGCGCGCGCGC', SUBSTR('GCGCGCGCGCGCGCGCGCGCGCGCGC',1,CAST(id % 23 AS INT)))
      WHEN 19 THEN NULL ELSE {_EDITED} END AS e FROM base_orders) t1"""

_TEXT_RECORDS = """
  SELECT row_id, CASE WHEN row_id % 31 = 0 THEN '' ELSE aptamer_sequence END AS aptamer_sequence,
    CASE WHEN row_id % 37 = 1 THEN 'DNA' WHEN row_id % 17 = 3 THEN 'ssRNA' ELSE 'ssDNA' END AS nucleic_acid_type,
    'none' AS modifications,
    CASE WHEN row_id % 29 = 0 THEN CONCAT('  ', target_name, ' ') ELSE target_name END AS target_name,
    CASE WHEN row_id % 43 = 0 THEN 'virus' ELSE target_type END AS target_type,
    target_id, CASE WHEN row_id % 5 = 0 THEN 'PDB' ELSE target_id_source END AS target_id_source,
    CASE WHEN row_id % 19 = 0 THEN 'n/a' WHEN row_id % 23 = 0 THEN '-4' WHEN row_id % 27 = 0 THEN NULL
      ELSE CAST(CAST(row_id % 500 + 1 AS INT) AS STRING) END AS kd_value,
    CASE WHEN row_id % 33 = 0 THEN NULL WHEN row_id % 21 = 0 THEN 'M' ELSE 'nM' END AS kd_unit,
    CAST(NULL AS STRING) AS assay_type,
    SPLIT_PART('PBS buffer|Tris-HCl|HEPES|saline', '|', CAST(row_id % 4 + 1 AS INT)) AS selection_buffer,
    CASE WHEN row_id % 3 = 0 THEN '' ELSE SPLIT_PART('phosphate|tris base|hepes 7|nan', '|', CAST(row_id % 4 + 1 AS INT)) END
      AS binding_buffer,
    CASE WHEN row_id % 16 = 0 THEN '15' WHEN row_id % 15 = 0 THEN 'x' WHEN row_id % 6 = 0 THEN '' ELSE CAST(CAST(6 + row_id % 3 AS INT) AS STRING) END AS ph,
    CAST(CAST(row_id % 300 AS INT) AS STRING) AS na_concentration_mM,
    CAST(CAST(row_id % 1200 AS INT) AS STRING) AS mg_concentration_mM,
    CAST(CAST(row_id % 90 AS INT) AS STRING) AS temperature_C,
    CASE WHEN row_id % 9 = 0 THEN '' ELSE CONCAT('10.1/', CAST(row_id AS STRING)) END AS source_doi,
    SPLIT_PART('paper|patent|database|preprint|blog', '|', CAST(row_id % 5 + 1 AS INT)) AS source_type,
    CASE WHEN row_id % 47 = 0 THEN 'flagged' ELSE 'extracted' END AS confidence_score,
    split
  FROM records"""

_SENTENCES = f"""
  SELECT id AS doc_id, CONCAT(
    CASE id % 4 WHEN 0 THEN 'We selected a DNA aptamer for ' WHEN 1 THEN 'SELEX against ' WHEN 2 THEN 'An aptamer targeting '
      ELSE 'A study of ' END, nm,
    CASE id % 5 WHEN 0 THEN ', in PBS at pH 7.4 with ' WHEN 1 THEN ' in selection buffer with HEPES at pH of 6.5 and '
      WHEN 2 THEN '. The binding buffer was Tris-HCl pH: 8. It held ' WHEN 3 THEN ' in sodium phosphate pH 15 and '
      ELSE ' without notes and ' END,
    CAST(CAST(50 + id % 150 AS INT) AS STRING),
    CASE id % 4 WHEN 0 THEN ' mM NaCl' WHEN 1 THEN ' mM KCl' WHEN 2 THEN ' mM salt' ELSE ' mM Na+' END,
    ' and ', CAST(CAST(1 + id % 9 AS INT) AS STRING), CASE id % 3 WHEN 0 THEN ' mM MgCl2' WHEN 1 THEN ' mM MgCl 2' ELSE ' mM sugar' END,
    ' at ', CAST(CAST(4 + id % 120 AS INT) AS STRING), CASE id % 3 WHEN 0 THEN ' C. ' WHEN 1 THEN ' degrees C, ' ELSE ' Celsius; ' END,
    'Measured by ', SPLIT_PART('SPR|ITC|EMSA gel|capillary electrophoresis SELEX|flow cytometry|cell-SELEX|nothing named|filter binding assay|MST|toggle SELEX',
      '|', CAST(id % 10 + 1 AS INT)), '. ',
    CASE id % 6 WHEN 0 THEN 'Kd = ' WHEN 1 THEN 'KD of ' WHEN 2 THEN 'kd: ' WHEN 3 THEN 'Kd was ' WHEN 4 THEN 'IC50 = ' ELSE 'Ki of ' END,
    CAST(CAST(1 + id % 900 AS INT) AS STRING),
    CASE id % 5 WHEN 0 THEN ' nM' WHEN 1 THEN ' pM' WHEN 2 THEN ' uM' WHEN 3 THEN ' +- 3 nM' ELSE 'mM' END,
    '. The sequence is 5''-', s, '-3'' here.') AS text, nm AS target_name, s AS planted
  FROM base_orders"""

# every form in which a text may name a sequence, one for each document
_PIECES = ", ".join(
    f"CASE WHEN LENGTH(SUBSTR(s,{k},10)) = 10 THEN SUBSTR(s,{k},10) END" for k in range(1, 120, 10)
)
_FORMS = f"""
  SELECT id AS doc_id, nm AS target_name, s, CAST(id % 5 AS INT) AS form, CASE WHEN id % 5 = 3 THEN SUBSTR(s, 1, CAST(LENGTH(s) - LENGTH(s) % 10 AS INT))
      WHEN id % 5 IN (1, 4) THEN TRANSLATE(s, 'T', 'U') ELSE s END AS planted,
    CONCAT('A study. ', CASE id % 5 WHEN 0 THEN CONCAT('It is 5''-', s, '-3'' here')
      WHEN 1 THEN CONCAT('It is 5''-', TRANSLATE(s, 'T', 'U'), '-3'' here') WHEN 2 THEN CONCAT('Clone 7 (', s, ') was found')
      WHEN 3 THEN CONCAT('Clone 8: ', CONCAT_WS(' ', {_PIECES}), ' was kept') ELSE CONCAT('Clone 9, ', TRANSLATE(s, 'T', 'U'), ', was seen') END, '.') AS text
  FROM base_orders"""

# shared text: name -> SQL with @table@ for shared tables
SHARED = {
    "base_orders": _base("orders", "o_orderkey", "o_totalprice"),
    "base_part": _base("part", "p_partkey", "p_retailprice"),
    "records": _records("base_orders"),
    "recs": _records("base_part"),
    "legacy": _LEGACY,
    "text_records": _TEXT_RECORDS,
    "sentences": _SENTENCES,
    "forms": _FORMS,
    # an older assignment: lower-case sequences, some rows augmented
    "old_splits": """
  SELECT CASE WHEN row_id % 3 < 2 THEN LOWER(aptamer_sequence) ELSE LOWER(aptamer_sequence) || 'ac' END AS sequence,
    UPPER(target_name) AS target_protein,
    CASE WHEN row_id % 4 = 0 THEN 'val' WHEN row_id % 4 = 1 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN row_id % 8 = 2 THEN TRUE ELSE FALSE END AS augmented
  FROM records""",
    # known rows: the keys of two in three rows are changed, so they are new
    "master": """
  SELECT l.row_id, CASE WHEN row_id % 3 = 0 THEN sequence ELSE sequence || 'AC' END AS sequence, target_protein, uniprot_id,
    protein_sequence, Kd_nM, pH, salt_mM, temp_C, buffer_type, mg_mM, label, source_pmid, training_tier, augmented,
    aug_method, needs_sequence_enrichment, source
  FROM legacy l""",
    "assayed": """
  SELECT id AS row_id, CASE WHEN id % 5 = 0 THEN 'RNA' ELSE 'ssDNA' END AS nucleic,
    CASE WHEN id % 17 = 0 THEN ' - ' ELSE CONCAT(' ', LOWER(SUBSTR(s,1,6)), ' ', SUBSTR(s,7), '-u ') END AS seq,
    CONCAT(' ', nm, ' ') AS target, CASE WHEN id % 4 = 0 THEN NULL ELSE price END AS kd,
    CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(6 + id % 3 AS DOUBLE) END AS ph,
    CASE WHEN id % 6 = 0 THEN NULL ELSE SPLIT_PART('PBS|Phosphate|50 mM HEPES|Tris|not reported', '|', CAST(id % 5 + 1 AS INT)) END AS buf,
    CASE WHEN id % 7 = 0 THEN 'none' ELSE CONCAT('https://pubmed.ncbi.nlm.nih.gov/', CAST(1000 + id AS STRING), '/') END AS link
  FROM base_orders""",
    "pairlist": """
  SELECT id AS row_id, CASE WHEN id % 9 = 0 THEN CONCAT('x', CAST(id AS STRING)) ELSE CONCAT(CAST(100 + id AS STRING), '-', nm, '-1') END AS aptamer_id,
    REPLACE(nm, ' ', '_') AS target_id, CASE WHEN id % 2 = 0 THEN ' Positive' ELSE 'negative' END AS class
  FROM base_orders""",
    "curated_export": """
  SELECT id AS row_id, CASE WHEN id % 13 = 0 THEN CONCAT(s, 'N') WHEN id % 5 = 0 THEN CONCAT(SUBSTR(s,1,5),'-',SUBSTR(s,6)) ELSE LOWER(s) END AS sequence,
    CASE WHEN id % 19 = 0 THEN '' ELSE CONCAT(nm, ' ') END AS target,
    CASE WHEN id % 6 = 0 THEN 'N/A' WHEN id % 7 = 0 THEN '-1' WHEN id % 8 = 0 THEN '' ELSE CAST(CAST(id % 900 + 1 AS INT) AS STRING) END AS kd,
    CASE WHEN id % 10 = 0 THEN 'ssRNA' ELSE 'ssDNA' END AS na_type,
    CASE WHEN id % 4 = 0 THEN '7' ELSE '' END AS ph, 'Tris' AS buf
  FROM base_orders""",
    # participants of an interaction: one aptamer side, one or two target sides
    "participants": """
  SELECT l_orderkey AS inter, CASE WHEN l_linenumber = 1 THEN CONCAT('apt', CAST(l_partkey AS STRING)) ELSE CONCAT('tgt', CAST(l_suppkey AS STRING)) END AS participant,
    CONCAT('target ', CAST(l_suppkey % 40 AS STRING)) AS participant_label,
    CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) / 1000000000 END AS kd_molar
  FROM @lineitem@""",
    "aptamer_table": """
  SELECT CONCAT('apt', CAST(id AS STRING)) AS id, CONCAT(CAST(1000 + id % 300 AS STRING), '-', nm, '-1') AS label,
    CASE WHEN id % 15 = 0 THEN NULL ELSE LOWER(s) END AS sequence,
    CASE WHEN id % 6 = 0 THEN 'modified' ELSE NULL END AS has_modification_details
  FROM base_part""",
    "feature_cache": """
  SELECT sequence, MIN(CAST(-(id % 40) AS DOUBLE) / 4) AS mfe, CAST(MIN(id % 5) AS INT) AS stem_count, CAST(MIN(id % 4) AS INT) AS loop_count,
    MIN(CAST(id % 10 AS DOUBLE) / 16) AS bp_prob_mean, MIN(CAST(id % 9 AS DOUBLE) / 8) AS bp_prob_max
  FROM (SELECT CASE WHEN src % 10 < 7 THEN s ELSE s || 'AC' END AS sequence, id FROM base_orders) t2 GROUP BY sequence""",
    "overrides": f"""
  SELECT DISTINCT CASE WHEN nm LIKE '%in%' THEN CONCAT(' ', UPPER(nm)) ELSE CONCAT('~', nm) END AS name,
    CONCAT('ACC', CAST(LENGTH(nm) % 7 AS STRING)) AS accession
  FROM base_part""",
    "proteins": """
  SELECT DISTINCT CONCAT('ACC', CAST(p_partkey % 1000 AS STRING)) AS accession,
    CONCAT('MKT', UPPER(MD5(CAST(p_partkey % 1000 AS STRING)))) AS protein_sequence
  FROM @part@""",
    "compound_ids": """
  SELECT DISTINCT CASE WHEN nm = 'ATP' THEN 'ATP?' ELSE nm END AS name, CAST(LENGTH(nm) * 17 AS STRING) AS cid FROM base_part""",
    # one article per customer: a table of its orders, sequences repeat between documents
    "table_cells": """
  SELECT o_custkey AS doc_id, CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS table_no, id AS row_no, s AS seq,
    CASE WHEN id % 6 = 0 THEN '' WHEN id % 6 = 1 THEN '> 5 nM' WHEN id % 6 = 2 THEN CONCAT(CAST(CAST(id % 90 + 1 AS INT) AS STRING), 'uM')
      ELSE CAST(CAST(id % 50 + 1 AS INT) AS STRING) END AS kd_cell,
    CASE WHEN id % 7 = 0 THEN 'N/A' ELSE nm END AS target_cell
  FROM base_orders JOIN @orders@ ON o_orderkey = src""",
    "predictions": """
  SELECT o_orderkey AS row_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS INT) AS y_true,
    (CAST(INSTR('0123456789abcdef', SUBSTR(h,1,1)) - 1 AS DOUBLE) * 256 + (INSTR('0123456789abcdef', SUBSTR(h,2,1)) - 1) * 16
      + (INSTR('0123456789abcdef', SUBSTR(h,3,1)) - 1) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 300 END) / 4400 AS y_prob,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 700 AS DOUBLE) / 100 END AS kd_true,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 650 AS DOUBLE) / 100 END AS kd_pred
  FROM (SELECT o_orderkey, MD5(CAST(o_orderkey AS STRING)) AS h FROM @orders@) t3""",
}


def needed(text: str, library: dict[str, str]) -> list[str]:
    """Names of the library used by ``text``, directly or not, in library order."""
    used: set[str] = set()

    def visit(sql: str) -> None:
        for name in library:
            if name not in used and re.search(rf"\b{name}\b", sql):
                used.add(name)
                visit(library[name])

    visit(text)
    return [n for n in library if n in used]


def with_clause(text: str, library: dict[str, str], recursive: bool = False) -> str:
    names = needed(text, library)
    body = ",\n".join(f"{n} AS ({library[n]})" for n in names)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + body + "\n" if names else "") + text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows over one partition per core, at least; only the columns that are used are moved."""
    return df.repartition(max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism))


def _made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The SQL of a derived table; the shared tables, single files here, are dealt out before the wide columns are made."""
    text = with_clause(f"SELECT * FROM {name}", SHARED)
    tables = {t: _dealt(table(spark, sf_dir, t)) for t in TABLES if f"@{t}@" in text}
    return spark.sql(re.sub(r"@(\w+)@", r"{\1}", text), **tables)


_WRITTEN: dict[tuple[str, str, str], str] = {}


def path_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder of a derived table, written once per session."""
    from strandloom.queries.registry import scratch

    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _WRITTEN:
        path = scratch(spark)
        _made(spark, sf_dir, name).write.parquet(path)
        _WRITTEN[at] = path
    return _WRITTEN[at]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, built by Spark from the shared tables.

    It is written once per session and then read like any landed table, so
    filters and column pruning stop at its scan.
    """
    return spark.read.parquet(path_of(spark, sf_dir, name))
