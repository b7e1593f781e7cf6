"""Column lists, vocabularies, word lists, patterns and limits.

Every value here has to be exactly this for results to be right, so they are
kept as plain text in one place.  No logic lives in this module.
"""

from __future__ import annotations

# --- fixed values: sequence limits ------------------------------------------
SEQ_MIN_LEN = 20
SEQ_MAX_LEN = 120
GC_MIN = 0.2
GC_MAX = 0.8
MAX_HOMOPOLYMER = 8
KMER_SIZE = 3
PAD_ID = 0
UNK_ID = 1
MAX_EDIT_DISTANCE = 2

# --- fixed values: default conditions ---------------------------------------
DEFAULT_PH = 7.4
DEFAULT_SALT_MM = 150.0
DEFAULT_TEMP_C = 37.0
DEFAULT_MG_MM = 2.0
DEFAULT_BUFFER_CODE = 0
DEFAULT_BUFFER_NAME = "PBS"

# --- fixed values: buffer codes ---------------------------------------------
BUFFER_RULES = (("pbs", 0), ("phosphate", 0), ("hepes", 1), ("tris", 2))
BUFFER_OTHER = 3
BUFFER_NAMES = {0: "PBS", 1: "HEPES", 2: "Tris", 3: "other"}

# --- fixed values: training tiers and thresholds ----------------------------
VALIDATION_TARGETS = ("insulin", "myoglobin", "nt-probnp", "troponin_i", "troponin_t", "albumin")
KD_HIGH_NM = 10.0
KD_MEDIUM_NM = 1000.0
PROB_HIGH = 0.66
PROB_MEDIUM = 0.33
PROTEIN_MAX_TOKENS = 1024
TOKEN_OVERLAP_MIN = 0.8
HOLDOUT = ("val", "test")
SPLITS = ("train", "val", "test")

# --- fixed values: column orders --------------------------------------------
LEGACY_COLUMNS = (
    "sequence", "target_protein", "uniprot_id", "protein_sequence", "Kd_nM", "pH",
    "salt_mM", "temp_C", "buffer_type", "mg_mM", "label", "source_pmid",
    "training_tier", "augmented", "aug_method", "needs_sequence_enrichment", "source",
)
RECORD_COLUMNS = (
    "aptamer_sequence", "nucleic_acid_type", "modifications", "target_name",
    "target_type", "target_id", "target_id_source", "kd_value", "kd_unit",
    "assay_type", "selection_buffer", "binding_buffer", "ph", "na_concentration_mM",
    "mg_concentration_mM", "temperature_C", "source_doi", "source_type",
    "confidence_score", "split",
)
RECORD_NUMERIC = ("kd_value", "ph", "na_concentration_mM", "mg_concentration_mM", "temperature_C")
CLEANED_EXTRA = ("protein_sequence", "label", "training_tier")
CLEANED_COLUMNS = RECORD_COLUMNS + CLEANED_EXTRA
SEQUENCE_ALIASES = ("aptamer_sequence", "sequence", "Sequence", "DNA_sequence", "seq")
TARGET_ALIASES = ("target_name", "target", "Target", "target_protein", "protein")
KD_ALIASES = ("kd_value", "kd", "kd_nm", "Kd_nM", "Kd", "affinity_nm")

# --- fixed values: record contract ------------------------------------------
REQUIRED = (
    "aptamer_sequence", "nucleic_acid_type", "modifications", "target_name",
    "target_type", "confidence_score", "split",
)
VOCABULARY = {
    "nucleic_acid_type": ("ssDNA", "ssRNA", "LNA", "2'-OMe RNA", "2'-F RNA", "other"),
    "target_type": (
        "protein", "peptide", "small_molecule", "cell", "organism", "ion", "toxin", "other",
    ),
    "target_id_source": (
        "UniProt", "PDB", "PubChem", "KEGG", "ChEBI", "BRENDA", "Cellosaurus",
        "NCBI_Taxonomy", "other",
    ),
    "kd_unit": ("pM", "nM", "µM", "uM", "mM"),
    "source_type": ("paper", "patent", "database", "preprint"),
    "confidence_score": ("curated", "extracted", "non-curated", "uncertain"),
    "split": ("train", "val", "test"),
}
BOUNDS = {
    "ph": (0.0, 14.0),
    "na_concentration_mM": (0.0, 10000.0),
    "mg_concentration_mM": (0.0, 1000.0),
    "temperature_C": (-80.0, 200.0),
}
# vocabulary of the cleaned table, wider than the record contract
CLEANED_VOCABULARY = {
    "confidence_score": ("curated", "extracted", "non-curated", "uncertain"),
    "nucleic_acid_type": ("ssDNA", "ssRNA", "LNA", "2'-OMe RNA", "2'-F RNA", "other", "unknown"),
    "source_type": ("paper", "patent", "database", "preprint", "other"),
    "target_type": (
        "protein", "peptide", "small_molecule", "cell", "organism", "ion", "toxin", "other",
    ),
    "split": ("train", "val", "test", "unassigned"),
}

# --- fixed values: source maps ----------------------------------------------
SOURCE_TO_TYPE = {
    "li2014": "paper", "utexas": "database", "aptamerbase": "database", "pubmed": "paper",
    "patent": "patent", "biorxiv": "preprint", "database": "database",
}
TYPE_TO_SOURCE = {
    "paper": "pubmed", "patent": "patent", "database": "database", "preprint": "biorxiv",
}
PLACEHOLDER_TARGETS = ("", "n/a", "na", "-")

# --- fixed values: units ----------------------------------------------------
UNIT_TO_NM = {"pm": 1e-3, "nm": 1.0, "µm": 1e3, "um": 1e3, "mm": 1e6}
UNIT_TO_NM_WITH_MOLAR = {"pm": 1e-3, "nm": 1.0, "µm": 1e3, "um": 1e3, "mm": 1e6, "m": 1e9}
UNIT_NAME = {"pm": "pM", "nm": "nM", "µm": "µM", "um": "µM", "mm": "mM"}

# --- fixed values: target classes of the cleaning step ----------------------
GARBAGE_PHRASES = (
    "according to claim", "use according", "said at least", "capable of being", "be capable",
    "be tightly", "the target by", "a microvesicle", "the surface material", "block binding",
    "inhibit histamine", "at 20 degrees", "is enthalpically", "procymidone is", "the sequence",
    "combined with", "a subject",
)
UNCERTAIN_PHRASES = (
    "according to claim", "use according", "be capable", "a subject", "the target", "unknown",
)
SMALL_MOLECULES = (
    "cocaine", "dopamine", "theophylline", "adenosine", "glucose", "cortisol", "testosterone",
    "estradiol", "progesterone", "hemin", "biotin", "atp", "adp", "amp", "gtp", "cgmp", "camp",
    "nad", "nadh", "fad", "fmn", "bisphenol a", "bpa", "diclofenac", "ibuprofen", "melamine",
    "toluene", "malachite green", "crystal violet", "kanamycin", "streptomycin", "tetracycline",
    "gentamicin", "tobramycin", "ampicillin", "chloramphenicol", "ciprofloxacin",
    "oxytetracycline", "fumonisin b1", "ochratoxin a", "aflatoxin b1", "zearalenone",
    "deoxynivalenol", "microcystin", "caffeine", "l-arginine", "l-lysine", "l-glutamine",
    "folic acid", "folate", "histamine", "serotonin", "epinephrine", "norepinephrine",
    "acetylcholine", "urea", "creatinine", "uric acid", "bilirubin", "cholesterol", "sucrose",
    "lactose", "fructose", "galactose", "mannose", "methamphetamine", "amphetamine", "morphine",
    "heroin", "lysergic acid", "lsd", "thc", "cannabidiol", "cbd", "nicotine", "cotinine",
    "procymidone", "7-methylguanosine triphosphate", "hoechst stain derivative",
    "flavin adenine dinucleotide-dependent glucose dehydrogenase", "h-acetyl-tobramycin",
    "8-oxodg",
    "10-carboxy-2,7-di-t-butyl-trans-12c,12d-dimethyl-12c,12d-dihydrobenzo[e]pyrene",
)
SMALL_MOLECULE_PARTS = (
    "ochratoxin", "aflatoxin", "fumonisin", "zearalenone", "deoxynivalenol", "mycotoxin",
    "polychlorinated", "biphenyl", "benzopyrene", "hoechst", "organophosphor", "pesticide",
    "herbicide", "aminoglycosid", "methamphetamin", "amphetamin", "cannabinoid", "cannabin",
    "tetrahydro", "procymidone", "antibiotic", "steroid hormone", "small molecule",
    "flavin adenine", "7-methylguanosin",
)
ION_PARTS = (
    "mercury", " lead ion", "arsenic ion", "cadmium ion", "zinc ion", "copper ion", "pb2+",
    "hg2+", "cd2+", "as3+", "silver ion", "lead(ii)", "mercury(ii)", "cadmium(ii)",
)
CELL_PARTS = (
    "cell line", "tumor cell", "cancer cell", "blood cell", "red blood cell", "exosome",
    "microvesicle", "extracellular vesicle", "platelet", "mast cell", "lymphocyte", "monocyte",
    "hela cell", "mcf-7", "ctc ", "circulating tumor", "ramos cell", "jurkat", "a549 cell",
    "cancer cell marker", "metastatic cancer cell",
)
ORGANISM_PARTS = (
    "salmonella", "listeria monocytogen", "staphylococcus", "pseudomonas aeruginosa",
    "mycobacterium tuberculosis", "campylobacter", "brucella", "yersinia", "aspergillus niger",
    "candida albicans", "cryptococcus",
)

# --- fixed values: target classes of the extraction step (first match wins) --
TARGET_TYPE_PATTERNS = (
    ("cell",
     r"\bcell\s*(?:line|surface|type)\b|\bHeLa\b|\bHEK\s*293\b|\bPC12\b|\bJurkat\b|\bRamos\b"
     r"|\bMCF-?7\b|\bA549\b|\bHT-?29\b|\bU87\b|\bK562\b"
     r"|\bwhole\s*cell\b|\bliving\s*cell\b|\bcell-SELEX\b"),
    ("organism",
     r"\b(?:Escherichia|Salmonella|Staphylococcus|Listeria|Bacillus|Clostridium|"
     r"Mycobacterium|Pseudomonas|Klebsiella|Vibrio|Campylobacter)\b"
     r"|\b(?:HIV|SARS-CoV|SARS-CoV-2|influenza|herpes|adenovirus|hepatitis|"
     r"coronavirus|parvovirus)\s+(?:virus|virion|particle)\b"
     r"|\bbacterium\b|\bbacteria\b|\bvirus\b|\bvirion\b|\bfungus\b|\byeast\b|\bparasite\b"),
    ("ion",
     r"\b(?:lead|mercury|cadmium|arsenic|copper|zinc|iron|cobalt|nickel|chromium|"
     r"manganese|silver|gold|platinum)\s*(?:ion|ions|[²³]?\+)?\b"
     r"|\b(?:Pb|Hg|Cd|As|Cu|Zn|Fe|Co|Ni|Cr|Mn|Ag|Au)\s*\d?[²³]?\+|\bheavy\s*metal\b"),
    ("toxin",
     r"\b(?:ochratoxin|aflatoxin|zearalenone|fumonisin|deoxynivalenol|"
     r"botulinum|ricin|abrin|tetrodotoxin|saxitoxin|microcystin)\b|\btoxin\b|\bmycotoxin\b"),
    ("small_molecule",
     r"\b(?:cocaine|codeine|morphine|heroin|amphetamine|methamphetamine|"
     r"ampicillin|kanamycin|tetracycline|streptomycin|doxorubicin|gentamicin|"
     r"chloramphenicol|penicillin|vancomycin|ciprofloxacin)\b"
     r"|\b(?:theophylline|caffeine|adenosine|dopamine|serotonin|epinephrine|norepinephrine)\b"
     r"|\b(?:ATP|ADP|AMP|GTP|GDP|NAD\+?|FAD|cAMP|cGMP)\b"
     r"|\b(?:sulforhodamine|rhodamine|fluorescein|malachite\s*green|crystal\s*violet)\b"
     r"|\b(?:riboflavin|folic\s*acid|vitamin\s*[A-EK]\d?|biotin)\b"
     r"|\b(?:glucose|sucrose|fructose|lactose|cholesterol|cortisol|estradiol|"
     r"progesterone|testosterone|bisphenol|PFAS|PCB)\b"),
    ("peptide",
     r"\b(?:peptide|epitope|fragment\s*\d+[-–]\d+|aa\s*\d+[-–]\d+)\b"
     r"|\b(?:angiotensin|bradykinin|substance\s*P|oxytocin|vasopressin|"
     r"glucagon|insulin\s*B\s*chain)\b"),
)
RECLASSIFY_PARTS = (
    ("cell", ("cell line", "hela", "hek", "pc12")),
    ("toxin", ("toxin", "mycotoxin", "aflatoxin", "ochratoxin")),
    ("ion", ("ion", "lead", "mercury", "cadmium")),
)

# --- fixed values: names that cannot be proteins ----------------------------
NON_PROTEIN_EXCEPTIONS = (
    "cell division cycle 42 gtp-binding protein",
    "quinoprotein glucose dehydrogenase pqqgdh",
    "flavin adenine dinucleotide-dependent glucose dehydrogenase",
)
NON_PROTEIN_PATTERNS = (
    r"\bcocaine\b", r"\bcodeine\b", r"\bmorphine\b", r"\bheroin\b", r"\bamphetamine\b",
    r"\bampicillin\b", r"\bkanamycin\b", r"\btetracycline\b", r"\bdoxorubicin\b",
    r"\btheophylline\b", r"\bcaffeine\b", r"\bchloramphenicol\b", r"\bpenicillin\b",
    r"\b(ATP|ADP|AMP|GTP(?!-binding)|GDP|NAD|cAMP)\b", r"\bmorpholine.*GTP\b",
    r"\bsulforhodamine\b", r"\brhodamine\b", r"\bfluorescein\b", r"\bmalachite\s*green\b",
    r"\bcrystal\s*violet\b", r"\bochratoxin\b", r"\baflatoxin\b", r"\bzearalenone\b",
    r"\bfumonisin\b", r"\bsialyllactose\b", r"\bcell\s*line\b", r"\bPC12\b", r"\bHeLa\b",
    r"\bHEK293\b", r"\bwhole\s*cell\b", r"\bvitamin\s*[A-E]\d?\b", r"\briboflavin\b",
    r"\bfolic\s*acid\b", r"\blead\s*ion\b", r"\bmercury\s*ion\b", r"\barsenic\b",
    r"\bcholic\s*acid\b", r"\bbile\s*acid\b", r"\bspermine\b", r"\bspermidine\b",
    r"\bcyclic\s*adenosine\s*monophosphate\b", r"\badenosine\s*triphosphate\b",
    r"\bmannose-capped\s*lipoarabinomannan\b",
)
NOISE_WORDS = (
    "human", "recombinant", "hiv-1", "hiv-2", "hiv1", "hiv2", "the", "of", "a", "an", "and",
    "or", "from", "in", "its", "full-length", "full", "length", "truncated", "domain",
    "his-tagged", "his", "tagged", "gst", "flag", "open", "reading", "frame", "orf",
)

# --- fixed values: priority targets of the coverage audit -------------------
PRIORITY_PATTERNS = (
    ("Insulin", r"(?i)\binsulin\b"),
    ("Myoglobin", r"(?i)\bmyoglobin\b"),
    ("Troponin", r"(?i)\btroponin\b"),
    ("NT-proBNP", r"(?i)(nt.?probnp|pro.?bnp)"),
    ("Albumin", r"(?i)\balbumin\b"),
)

# --- fixed values: keyword gates --------------------------------------------
GATE_WORKS = r"\baptamer\b|\bSELEX\b"
GATE_PREPRINT = r"\baptamer\b|\bSELEX\b|\bDNA\s+binding\b|\bRNA\s+aptamer\b"
GATE_PATENT = r"\baptamer\b|\bSELEX\b|\bssDNA\b"
PREPRINT_CATEGORIES = ("bioinformatics", "biochemistry", "molecular-biology", "synthetic-biology")

# --- fixed values: text patterns, sequences ---------------------------------
SEQ_PRIME = r"5['’ʼ]\s*-?\s*([ATGCUatgcu]{20,120})\s*-?\s*3['’ʼ]"
SEQ_RNA_PRIME = r"5['’ʼ]\s*-?\s*([AUGCaugc]{20,120})\s*-?\s*3['’ʼ]"
SEQ_PRIMARY = r"\b([ATGCatgc]{20,120})\b"
SEQ_SPACED = r"\b([ATGCatgc]{5,}(?:[ \t]+[ATGCatgc]{5,}){1,20})\b"
SEQ_RNA = r"\b([AUGCaugc]{20,120})\b"
SEQ_CELL = r"\b([ATGCatgc]{18,120})\b"
SEQ_COLUMN_HEADER = r"sequence|aptamer|oligo|primer|probe|nucleotide|dna|rna"
SEQ_COLUMN_CELL = r"^[ATGCU]{20,120}$"

# --- fixed values: text patterns, affinities --------------------------------
KD_TEXT = (
    r"\b[Kk][Dd]\b\s*(?:=|:\s*|\bof\b|\bwas\b|\bis\b|\s)\s*"
    r"(\d+\.?\d*(?:[eE][+-]?\d+)?)\s*(?:[±\+\-]\s*\d+\.?\d*\s*)?(pM|nM|[µu]M|mM|M\b)"
)
KD_SCIENTIFIC = (
    r"\b[Kk][Dd]\b\s*(?:=|of|:|\s)\s*(\d+\.?\d*)\s*[×x\*]\s*10\s*\^?\s*(-\d+)\s*M\b"
)
KD_PROXY = (
    r"\b(IC50|EC50|Ki)\b\s*(?:=|of|:|\s)\s*(\d+\.?\d*(?:[eE][+-]?\d+)?)\s*"
    r"(?:[±\+\-]\s*\d+\.?\d*\s*)?(pM|nM|[µu]M|mM)"
)
KD_WHOLE = r"^\s*(\d+\.?\d*(?:[eE][+-]?\d+)?)\s*(pM|nM|[µu]M|mM)\s*$"
KD_CELL = r"(\d+\.?\d*(?:[eE][+-]?\d+)?)\s*(?:[±\+\-]\s*\d+\.?\d*\s*)?(pM|nM|[µu]M|mM)\b"
KD_BARE = r"^\s*(\d+\.?\d*(?:[eE][+-]?\d+)?)\s*$"
KD_HEADER_UNIT = r"\(?(pM|nM|[µu]M|mM)\)?"

# --- fixed values: text patterns, table headers -----------------------------
SEQ_HEADER = (
    r"\b(?:sequence|oligo(?:nucleotide)?|ssDNA|nucleotide\s*sequence|"
    r"aptamer\s+(?:sequence|seq)|DNA\s+(?:sequence|seq)|"
    r"(?:selected|final|consensus)\s+(?:sequence|seq)|5[''ʼ].{0,10}3[''ʼ])\b"
)
KD_HEADER = (
    r"\b(?:Kd|KD|K_d|K_D|dissociation|affinity|binding\s*constant|"
    r"IC50|EC50|Ki|Kd\s*\(?nM\)?|Kd\s*\(?µM\)?|Kd\s*\(?pM\)?)\b"
)
TARGET_HEADER = r"\b(?:target|protein|molecule|analyte|ligand|antigen)\b"

# --- fixed values: text patterns, conditions --------------------------------
PH_TEXT = r"pH\s*(?:=|of|:|\s)\s*(\d+\.?\d*)"
NA_TEXT = (
    r"(\d+\.?\d*)\s*mM\s*(?:NaCl|KCl|Na\s*Cl|Na\+|K\+|sodium\s*chloride|"
    r"potassium\s*chloride|NaCl/KCl)"
)
IONIC_TEXT = r"(\d+\.?\d*)\s*mM\s*(?:salt|ionic\s*strength)"
MG_TEXT = (
    r"(\d+\.?\d*)\s*mM\s*(?:MgCl\s*2|MgCl₂|Mg\s*2\+|Mg\s*²\+|MgSO\s*4|MgSO₄|magnesium)"
)
TEMP_TEXT = r"(\d+\.?\d*)\s*°?\s*(?:degrees?\s*)?C(?:elsius)?(?:\s|,|\.|;|\))"
BUFFER_PATTERNS = (
    ("PBS", r"\bPBS\b|phosphate[- ]buffered\s+saline|phosphate\s+buffered\s+saline"),
    ("HEPES", r"\bHEPES\b"),
    ("Tris", r"\bTris(?:-HCl|-EDTA|-base)?\b"),
    ("SELEX", r"\b(?:selection|binding|SELEX)\s+buffer\b"),
    ("Sodium phosphate", r"\bsodium\s+phosphate\b"),
    ("other", r"\bbuffer\b"),
)
SELECTION_BUFFER = r"\bselection\s+buffer\b"
BINDING_BUFFER = r"\b(?:binding|assay|measurement|incubation|SPR|ITC|EMSA)\s+buffer\b"
SENTENCE_BREAK = r"[.!?;]\s+"

# --- fixed values: assay methods (first match wins) -------------------------
ASSAY_PATTERNS = (
    ("CE-SELEX", r"\b(?:CE-SELEX|capillary\s+electrophoresis\s+(?:SELEX|selection))\b"),
    ("Microfluidic SELEX",
     r"\b(?:microfluidic\s+SELEX|micro-?fluidic\s+(?:selection|aptamer))\b"),
    ("Cell-SELEX", r"\b(?:cell-SELEX|cell\s+SELEX|whole.cell\s+SELEX|Cell-Systematic)\b"),
    ("Capture SELEX", r"\b(?:capture-SELEX|capture\s+SELEX)\b"),
    ("Toggle SELEX", r"\b(?:toggle-SELEX|toggle\s+SELEX)\b"),
    ("Magnetic bead SELEX",
     r"\b(?:magnetic\s+bead\s+SELEX|bead-based\s+SELEX|MACS-SELEX|"
     r"magnetic\s+(?:bead|particle)\s+(?:selection|aptamer))\b"),
    ("SPR", r"\b(?:SPR|surface\s+plasmon\s+resonance|Biacore)\b"),
    ("ITC", r"\b(?:ITC|isothermal\s+titration\s+calorimetry)\b"),
    ("EMSA",
     r"\b(?:EMSA|electrophoretic\s+mobility\s+shift|gel\s+shift\s+assay|band\s+shift\s+assay)\b"),
    ("MST", r"\b(?:MST|microscale\s+thermophoresis)\b"),
    ("BLI", r"\b(?:BLI|bio-?layer\s+interferometry|Octet)\b"),
    ("Nitrocellulose filter",
     r"\b(?:nitrocellulose\s+filter|filter\s+binding\s+assay|membrane\s+filter\s+assay)\b"),
    ("Fluorescence anisotropy",
     r"\b(?:fluorescence\s+(?:anisotropy|polarization)|FA\s+(?:binding|assay))\b"),
    ("Flow cytometry", r"\b(?:flow\s+cytometry|FACS\s+(?:assay|binding|screening))\b"),
    ("SELEX", r"\b(?:SELEX|systematic\s+evolution\s+of\s+ligands)\b"),
)

# --- fixed values: target mentions ------------------------------------------
TARGET_PHRASE = (
    r"(?:aptamer|SELEX)\s+(?:for|against|targeting|binding|to)\s+"
    r"([A-Za-z0-9\-\s]+?)(?:\s*(?:,|\.|\band\b|with\b|in\b))"
)
KNOWN_TARGETS = (
    r"\b(thrombin|VEGF|insulin|lysozyme|myoglobin|troponin|albumin|"
    r"PSA|IgE|MUC1|HIV|influenza|HER2|PDGF|epidermal\s+growth\s+factor|"
    r"NT-proBNP|proBNP|C-reactive\s+protein|CRP|streptavidin|fibrinogen|"
    r"nucleolin|tenascin|osteopontin|transferrin|fibronectin)\b"
)

# --- fixed values: supplements ----------------------------------------------
SUPPLEMENT_KEEP = (".xlsx", ".xls", ".csv", ".tsv", ".pdf", ".txt")
SUPPLEMENT_MAX_FILES = 8
SUPPLEMENT_MAX_BYTES = 20 * 1024 * 1024

# --- fixed values: page parsing ---------------------------------------------
NOISE_TAGS = ("script", "style", "nav", "header", "footer", "aside", "noscript")
BLOCK_TAGS = (
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "section", "article",
)
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
)

# --- fixed values: curated source constants ---------------------------------
CURATED_SOURCES = {
    "utexas": {"source_doi": "10.5281/zenodo.8264921", "confidence": "curated", "strip_dash": False},
    "aptamerbase": {
        "source_doi": "github.com/micheldumontier/aptamerbase",
        "confidence": "non-curated", "strip_dash": True,
    },
    "li2014": {
        "source_doi": "10.1371/journal.pone.0086729", "confidence": "curated", "strip_dash": False,
    },
}
CURATED_RENAMES = {
    "Sequence": "aptamer_sequence", "Target": "target_name", "Kd (nM)": "kd_value",
    "Type": "nucleic_acid_type", "pH": "ph", "Temperature (°C)": "temperature_C",
    "NaCl (mM)": "na_concentration_mM", "MgCl2 (mM)": "mg_concentration_mM",
    "Buffer": "selection_buffer",
}
