"""Column functions on nucleotide strings.  All native, all row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions.bind import bind
from strandloom.functions.space import strip


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def reverse_complement_iupac(c: Column) -> Column:
    """Reverse complement over the ambiguity alphabet, both cases."""
    return F.reverse(
        F.translate(c, "ATGCRYSWKMBDHVNatgcryswkmbdhvn", "TACGYRSWMKVHDBNtacgyrswmkvhdbn")
    )


def clean_sequence(c: Column) -> Column:
    """Upper case, nucleotides only, U as T; an empty result is NULL."""
    letters = F.regexp_replace(F.upper(strip(c)), "[^ATGCU]", "")
    return F.nullif(F.translate(letters, "U", "T"), F.lit(""))


def normalise_match(c: Column, rna: bool = False) -> Column:
    packed = F.upper(F.translate(c, " \t", ""))
    return packed if rna else F.translate(packed, "U", "T")


def gc_content(c: Column) -> Column:
    upper = F.upper(c)
    gc = F.length(upper) - F.length(F.translate(upper, "GC", ""))
    return F.try_divide(gc, F.length(upper))


def homopolymer_flag(c: Column, limit: int = fv.MAX_HOMOPOLYMER, bases: str = "ATGC") -> Column:
    return c.rlike("|".join(f"{b}{{{limit + 1},}}" for b in bases))


def _runs(c: Column) -> Column:
    return F.regexp_extract_all(F.upper(c), F.lit("(A+|C+|G+|T+)"), F.lit(1))


def longest_run(c: Column) -> Column:
    """Length of the longest run of one base, 0 for an empty string."""
    return F.coalesce(F.array_max(F.transform(_runs(c), F.length)), F.lit(0))


def longest_run_base(c: Column) -> Column:
    """The first of the longest runs, as text."""
    ranked = F.transform(
        _runs(c), lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("at"), r.alias("run"))
    )
    return F.array_max(ranked)["run"]


def kmer_set(c: Column, k: int = 6) -> Column:
    def build(s):
        last = F.length(s) - (k - 1)
        return F.when(
            last >= 1,
            F.array_distinct(
                F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(s, i, F.lit(k)))
            ),
        ).otherwise(F.array().cast("array<string>"))

    return bind(c, build)


def kmer_tokens(c: Column) -> Column:
    """Ids of overlapping 3-mers.

    Three-mers sort as A<C<G<T, so the id is positional arithmetic; anything
    with another letter is the unknown id.
    """
    digits = F.transform(
        F.split(F.upper(strip(c)), ""), lambda b: F.instr(F.lit("ACGT"), b)
    )

    def tokens(d):
        def token(i):
            x, y, z = F.get(d, i), F.get(d, i + 1), F.get(d, i + 2)
            return F.when(
                (x > 0) & (y > 0) & (z > 0), (x - 1) * 16 + (y - 1) * 4 + z + 1
            ).otherwise(F.lit(fv.UNK_ID))

        last = F.size(d) - fv.KMER_SIZE
        return F.when(
            last >= 0, F.transform(F.sequence(F.lit(0), last), token)
        ).otherwise(F.array().cast("array<int>"))

    return bind(digits, tokens)


def kmer_tokens_padded(c: Column, size: int = fv.SEQ_MAX_LEN) -> Column:
    return F.slice(
        F.concat(kmer_tokens(c), F.array_repeat(F.lit(fv.PAD_ID), size)), 1, size
    )


def kmer_decode(ids: Column) -> Column:
    """First letter of every token but the last, then the last one whole."""

    def letter(code):
        return F.substring(F.lit("ACGT"), code.cast("int") + 1, F.lit(1))

    def word(i):
        code = i - 2
        return (
            F.when(i == fv.UNK_ID, F.lit("[UNK]"))
            .when(
                (i >= 2) & (i <= 65),
                F.concat(
                    letter(F.floor(code / 16)), letter(F.floor(code / 4) % 4), letter(code % 4)
                ),
            )
            .otherwise(F.lit("?"))
        )

    def join(words):
        head = F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.substring(w, 1, 1)
        )
        return F.when(F.size(words) == 0, F.lit("")).otherwise(
            F.concat(F.array_join(head, ""), F.element_at(words, -1))
        )

    return bind(F.transform(F.filter(ids, lambda i: i != fv.PAD_ID), word), join)


def bounded_levenshtein(a: Column, b: Column, bound: int = fv.MAX_EDIT_DISTANCE) -> Column:
    """Edit distance, or bound + 1 when it is larger."""
    d = F.levenshtein(a, b, bound)
    return F.when(d < 0, F.lit(bound + 1)).otherwise(d)


def stem_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\(+"))


def loop_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\(\.*\)"))


def nucleic_acid_type(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == "") | (c == "nan"), "unknown")
        .when(c.rlike("[Uu]"), "ssRNA")
        .when(strip(c).rlike("^[ATGCatgc]+$"), "ssDNA")
        .otherwise("other")
    )


def is_augment_valid(c: Column) -> Column:
    """Length, alphabet and GC share; the run rule is left out on purpose."""
    upper = F.upper(c)
    return (
        F.length(c).between(fv.SEQ_MIN_LEN, fv.SEQ_MAX_LEN)
        & upper.rlike("^[ATGC]+$")
        & gc_content(c).between(fv.GC_MIN, fv.GC_MAX)
    )


def is_trainable_dna(c: Column) -> Column:
    seq = F.upper(strip(c))
    return F.coalesce(
        seq.rlike("^[ATGC]+$") & F.length(seq).between(fv.SEQ_MIN_LEN, fv.SEQ_MAX_LEN),
        F.lit(False),
    )


def sequence_fault(c: Column, bases: str = "ATGC", normal: bool = False) -> Column:
    """Message of the first rule a sequence breaks, '' when it breaks none.

    ``normal``: it is in upper case and has no white space, as ``normalise_match`` leaves it.
    """
    seq = c if normal else F.upper(strip(c))
    size = F.length(seq)
    strangers = F.array_sort(
        F.array_distinct(F.split(F.regexp_replace(seq, f"[{bases}]", ""), ""))
    )
    gc = gc_content(seq)
    shown = F.format_number(gc, 2)  # rounds half to even on the exact double
    return (
        F.when(c.isNull(), "not_a_string")
        .when(size < fv.SEQ_MIN_LEN,
              F.concat(F.lit("too_short ("), size, F.lit(f" < {fv.SEQ_MIN_LEN})")))
        .when(size > fv.SEQ_MAX_LEN,
              F.concat(F.lit("too_long ("), size, F.lit(f" > {fv.SEQ_MAX_LEN})")))
        .when(~seq.rlike(f"^[{bases}]*$"),
              F.concat(F.lit("invalid_bases ("), F.array_join(strangers, ","), F.lit(")")))
        .when(gc < fv.GC_MIN, F.concat(F.lit("gc_too_low ("), shown, F.lit(f" < {fv.GC_MIN})")))
        .when(gc > fv.GC_MAX, F.concat(F.lit("gc_too_high ("), shown, F.lit(f" > {fv.GC_MAX})")))
        .when(homopolymer_flag(seq, bases=bases),
              F.lit(f"homopolymer_run (>{fv.MAX_HOMOPOLYMER} identical bases)"))
        .otherwise("")
    )


def rna_fault(c: Column, normal: bool = False) -> Column:
    return sequence_fault(c, bases="AUGC", normal=normal)


TRUNCATIONS = (("trunc_L2", "left", 2), ("trunc_R2", "right", 2),
               ("trunc_L3", "left", 3), ("trunc_R3", "right", 3))


def truncate(c: Column, side: str, n: int) -> Column:
    """Drop ``n`` bases at one end."""
    keep = F.greatest(F.length(c) - n, F.lit(0))
    return F.substring(c, F.lit(n + 1), keep) if side == "left" else F.substring(c, F.lit(1), keep)


def truncations(c: Column) -> Column:
    """The four truncated variants as array<struct<method, sequence>>."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("method"), truncate(c, side, n).alias("sequence"))
            for name, side, n in TRUNCATIONS
        ]
    )


def scramble(c: Column, key: Column, seed: int = 42) -> Column:
    """Seeded shuffle keeping the composition: letters ordered by a hash.

    Order key is ``md5(seed|key|position)``, so any engine can repeat it.
    """

    def shuffle(letters):
        placed = F.transform(
            letters,
            lambda b, i: F.struct(
                F.md5(
                    F.concat_ws("|", F.lit(str(seed)), key.cast("string"), (i + 1).cast("string"))
                    .cast("binary")
                ).alias("o"),
                b.alias("b"),
            ),
        )
        return F.array_join(F.transform(F.array_sort(placed), lambda x: x["b"]), "")

    return F.when(F.length(c) == 0, F.lit("")).otherwise(
        bind(F.split(F.upper(c), ""), shuffle)
    )


def md5_key(c: Column, max_tokens: int = fv.PROTEIN_MAX_TOKENS) -> Column:
    """Cache key of a protein embedding cut at ``max_tokens``."""
    return F.md5(F.concat(F.lit(f"{max_tokens}:"), c).cast("binary"))
