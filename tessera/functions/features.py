"""Feature sets of the classifiers: which columns, in which order, and by which blocks they are judged."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from tessera.functions.rna import BASES

# Names of the columns of each set.
STATIC = ["viennarna_MFE_per_nt", "nupack_MFE_per_nt", "viennarna_ensemble_diversity", "viennarna_mean_positional_entropy", "nupack_max_stem_length", "nupack_max_loop_length", "viennarna_max_loop_length", "viennarna_max_stem_length"]
COMPOSITION = ["seq_length", "viennarna_gc_content", "nupack_gc_content", "P_paired_RBS_37"]
MELTING = ["nupack_Tm", "nupack_hill_coeff", "nupack_amplitude", "viennarna_Tm", "viennarna_hill_coeff", "viennarna_amplitude", "viennarna_mfe_zscore", "viennarna_delta_P_RBS", "viennarna_delta_delta_G"]
CIRCULAR = [
    "nupack_MFE_per_nt", "nupack_max_stem_frac", "nupack_max_loop_frac", "nupack_mean_exposure", "nupack_gc_content", "nupack_Tm", "nupack_hill_coeff", "nupack_amplitude",
    "viennarna_MFE_per_nt", "viennarna_max_loop_frac", "viennarna_gc_content", "viennarna_mean_unpaired_prob", "viennarna_Tm", "viennarna_hill_coeff", "viennarna_amplitude",
    "viennarna_mfe_zscore", "viennarna_delta_P_RBS", "viennarna_delta_delta_G", "viennarna_ensemble_diversity", "viennarna_mean_positional_entropy",
]
LEGACY = [
    "nupack_MFE", "nupack_max_stem_length", "nupack_max_loop_length", "nupack_mean_exposure", "nupack_gc_content", "nupack_Tm", "nupack_hill_coeff", "nupack_amplitude",
    "viennarna_MFE", "viennarna_max_loop_length", "viennarna_gc_content", "viennarna_mean_unpaired_prob", "viennarna_Tm", "viennarna_hill_coeff", "viennarna_amplitude",
]

BLOCKS = {
    "static": STATIC,
    "composition": COMPOSITION,
    "dinucleotides": ["dinuc_" + "".join(p) for p in product(BASES, repeat=2)],
    "trinucleotides": ["trinuc_" + "".join(p) for p in product(BASES, repeat=3)],
    "spacing": ["sd_aug_spacing", "sd_aug_missing"],
}


def feature_columns(columns: Iterable[str], which: str) -> list[str]:
    """The columns of a set that are there, in the set's order; ``noncircular`` takes one GC content, the first engine's where both are there."""
    sets = {"noncircular": [c for block in BLOCKS.values() for c in block], "circular": CIRCULAR, "legacy": LEGACY}
    if which not in sets:
        raise ValueError(f"feature set {which!r}: one of {', '.join(sets)}")
    there = set(columns)
    if which == "noncircular" and {"viennarna_gc_content", "nupack_gc_content"} <= there:
        there.discard("nupack_gc_content")
    return [c for c in sets[which] if c in there]
