"""Alphabets, ambiguity codes and genetic codes."""
from __future__ import annotations

import re

# Alphabets in their natural order.
DNA_BASES = "ACGT"
RNA_BASES = "ACGU"
DNA_ALPHABET = "ACGTMRWSYKVHDBN-+."
RNA_ALPHABET = "ACGUMRWSYKVHDBN-+."
AA_STANDARD = "ARNDCQEGHILKMFPSTWYV"
AA_PROTEINOGENIC = "ARNDCQEGHILKMFPSTWYVUO"
AA_ALPHABET = "ARNDCQEGHILKMFPSTWYVUOBJZX*-+."

# The bases each ambiguity letter stands for.
IUPAC_CODE_MAP = {
    "A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
_BIT = {"A": 1, "C": 2, "G": 4, "T": 8}
#: letter -> code; an ambiguity letter is the OR of its bases
LETTER_CODE = {letter: sum(_BIT[b] for b in bases) for letter, bases in IUPAC_CODE_MAP.items()} | {"-": 16, "+": 32, ".": 64}
#: letters by code 1..15
LETTERS_BY_CODE = "".join(sorted(IUPAC_CODE_MAP, key=LETTER_CODE.get))
#: letters in the order in which sequences compare
ORDER_BY_CODE = LETTERS_BY_CODE + "-+."

_PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}
COMPLEMENT = {
    letter: next(x for x, b in IUPAC_CODE_MAP.items() if set(b) == {_PAIR[c] for c in bases}) for letter, bases in IUPAC_CODE_MAP.items()
}

# Three-letter names of the amino acids.
AMINO_ACID_CODE = {
    "A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile",
    "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val",
    "U": "Sec", "O": "Pyl", "B": "Asx", "J": "Xle", "Z": "Glx", "X": "Xaa",
}

# The standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT, ... GGG.
_STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]

# The other genetic codes as differences to the standard one, with their start codons.
_CODES = {
    "1": ("Standard", "SGC0", {}, "TTG CTG ATG"),
    "2": ("Vertebrate Mitochondrial", "SGC1", {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, "ATT ATC ATA ATG GTG"),
    "3": ("Yeast Mitochondrial", "SGC2", {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"}, "ATA ATG"),
    "4": ("Mold Mitochondrial; Protozoan Mitochondrial; Coelenterate Mitochondrial; Mycoplasma; Spiroplasma", "SGC3", {"TGA": "W"}, "TTA TTG CTG ATT ATC ATA ATG GTG"),
    "5": ("Invertebrate Mitochondrial", "SGC4", {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"}, "TTG ATT ATC ATA ATG GTG"),
    "6": ("Ciliate Nuclear; Dasycladacean Nuclear; Hexamita Nuclear", "SGC5", {"TAA": "Q", "TAG": "Q"}, "ATG"),
    "9": ("Echinoderm Mitochondrial; Flatworm Mitochondrial", "SGC8", {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"}, "ATG GTG"),
    "10": ("Euplotid Nuclear", "SGC9", {"TGA": "C"}, "ATG"),
    "11": ("Bacterial, Archaeal and Plant Plastid", None, {}, "TTG CTG ATT ATC ATA ATG GTG"),
    "12": ("Alternative Yeast Nuclear", None, {"CTG": "S"}, "CTG ATG"),
    "13": ("Ascidian Mitochondrial", None, {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"}, "TTG ATA ATG GTG"),
    "14": ("Alternative Flatworm Mitochondrial", None, {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"}, "ATG"),
    "15": ("Blepharisma Macronuclear", None, {"TAG": "Q"}, "ATG"),
    "16": ("Chlorophycean Mitochondrial", None, {"TAG": "L"}, "ATG"),
    "21": ("Trematode Mitochondrial", None, {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"}, "ATG GTG"),
    "22": ("Scenedesmus obliquus Mitochondrial", None, {"TCA": "*", "TAG": "L"}, "ATG"),
    "23": ("Thraustochytrium Mitochondrial", None, {"TTA": "*"}, "ATT ATG GTG"),
    "24": ("Pterobranchia Mitochondrial", None, {"AGA": "S", "AGG": "K", "TGA": "W"}, "TTG CTG ATG GTG"),
    "25": ("Candidate Division SR1 and Gracilibacteria", None, {"TGA": "G"}, "TTG ATG GTG"),
    "26": ("Pachysolen tannophilus Nuclear", None, {"CTG": "A"}, "CTG ATG"),
}


def genetic_code(id_or_name2: str = "1", full_search: bool = False) -> tuple[dict[str, str], list[str]]:
    """(codon -> amino acid, alternative start codons); by id, by short name, or by a pattern of the name.

    A pattern that fits no code or several is an error.
    """
    hits = [k for k, v in _CODES.items() if id_or_name2 == k or id_or_name2 == v[1]]
    if not hits and full_search:
        hits = [k for k, v in _CODES.items() if re.search(id_or_name2, v[0], re.I)]
    if len(hits) != 1:
        raise ValueError(f"{id_or_name2!r} fits {len(hits)} genetic codes")
    _, _, changes, starts = _CODES[hits[0]]
    code = dict(zip(_CODONS, _STANDARD)) | changes
    return code, [c for c in starts.split() if code[c] != "M"]


def genetic_code_table() -> list[tuple[str, str, str | None]]:
    """(id, name, short name) of every code."""
    return [(k, v[0], v[1]) for k, v in _CODES.items()]


GENETIC_CODE = genetic_code()[0]
RNA_GENETIC_CODE = {k.replace("T", "U"): v for k, v in GENETIC_CODE.items()}


def merge_iupac(letters: str) -> str:
    """The ambiguity letter for all the bases that the given letters stand for."""
    code = 0
    for c in letters.upper():
        if c not in IUPAC_CODE_MAP:
            raise ValueError(f"{c!r} is not a base or an ambiguity letter")
        code |= LETTER_CODE[c]
    return LETTERS_BY_CODE[code - 1]


def fuzzy_code(code: dict[str, str], mode: str) -> dict[str, str | None]:
    """Codons with ambiguity letters -> amino acid: ``solve`` (the one all readings agree on, else X), ``error.if.X`` (None where
    they don't agree), ``X`` (always X) or ``error`` (always None)."""
    out: dict[str, str | None] = {}
    for a, x in IUPAC_CODE_MAP.items():
        for b, y in IUPAC_CODE_MAP.items():
            for c, z in IUPAC_CODE_MAP.items():
                codon = a + b + c
                if codon in code:
                    out[codon] = code[codon]
                elif mode in ("X", "error"):
                    out[codon] = "X" if mode == "X" else None
                else:
                    aa = {code[p + q + r] for p in x for q in y for r in z}
                    out[codon] = aa.pop() if len(aa) == 1 else "X" if mode == "solve" else None
    return out
