"""Fixed values of the domain: registries, tables and thresholds."""

# Loci by class.
CLASS_I = ("A", "B", "C")
CLASS_II = ("DRB1", "DQA1", "DQB1", "DPA1", "DPB1")
EXTENDED = ("DRB3", "DRB4", "DRB5", "DRA", "E", "F", "G")
DEFAULT_LOCI = CLASS_I + CLASS_II
CNV_LOCI = ("DRB3", "DRB4", "DRB5")
REFERENCE_LOCUS = "DRB1"

# Exons that typing needs; all other loci need exon 2.
TWO_EXON_LOCI = ("A", "B", "C", "E", "F", "G")

# Fields that an assay can resolve, class I and class II; any other locus resolves 2.
MAX_FIELDS = {"short": (3, 2), "exome": (2, 2), "targeted_capture": (4, 4), "pacbio": (4, 4), "hifi": (4, 4), "ont": (3, 3), "rna": (2, 2)}

# The region by genome build.
REGIONS = {
    "GRCh38": ("chr6", 28510120, 33480577),
    "hg38": ("chr6", 28510120, 33480577),
    "T2T": ("chr6", 28510120, 33480577),
    "GRCh37": ("6", 28477797, 33448354),
    "hg19": ("chr6", 28477797, 33448354),
}

# Gene model of locus A, half-open, and cut points of the others as shares of the length.
GENE_MODEL_A = (("utr_5", 0, 300), ("exon_1", 300, 573), ("intron_1", 573, 700), ("exon_2", 700, 970), ("intron_2", 970, 1200), ("exon_3", 1200, 1470), ("intron_3", 1470, 1900), ("exon_4", 1900, 2176), ("intron_4", 2176, 2400), ("exon_5", 2400, 2500), ("utr_3", 2500, 3500))
CLASS_I_CUTS = (0.08, 0.15, 0.20, 0.28, 0.35, 0.43, 0.55, 0.63, 0.70, 0.73, 1.0)
CLASS_II_CUTS = (0.05, 0.10, 0.20, 0.30, 0.60, 0.67, 0.80, 0.85, 1.0)

# The standard genetic code, bases in the order TCAG.
CODONS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Global allele frequencies.
FREQUENCIES = {
    "A*02:01": 0.170, "A*01:01": 0.100, "A*03:01": 0.080, "A*24:02": 0.075, "A*11:01": 0.065, "A*68:01": 0.035, "A*23:01": 0.030,
    "A*30:01": 0.028, "A*26:01": 0.025, "A*31:01": 0.025, "A*32:01": 0.022, "A*33:03": 0.020, "A*29:02": 0.018, "A*30:02": 0.015,
    "A*02:06": 0.015, "A*68:02": 0.014, "A*33:01": 0.012, "A*34:01": 0.010, "A*36:01": 0.008, "A*74:01": 0.008,
    "B*07:02": 0.080, "B*08:01": 0.060, "B*35:01": 0.050, "B*44:02": 0.045, "B*15:01": 0.040, "B*40:01": 0.038, "B*51:01": 0.035,
    "B*44:03": 0.030, "B*18:01": 0.028, "B*27:05": 0.025, "B*57:01": 0.022, "B*14:02": 0.020, "B*53:01": 0.018, "B*58:01": 0.016,
    "B*13:02": 0.015, "B*38:01": 0.014, "B*49:01": 0.012, "B*52:01": 0.012, "B*55:01": 0.010, "B*56:01": 0.008,
    "C*07:01": 0.120, "C*07:02": 0.100, "C*04:01": 0.090, "C*06:02": 0.060, "C*03:04": 0.055, "C*05:01": 0.050, "C*01:02": 0.045,
    "C*03:03": 0.040, "C*08:02": 0.035, "C*12:03": 0.032, "C*02:02": 0.028, "C*15:02": 0.025, "C*16:01": 0.022, "C*14:02": 0.018,
    "C*08:01": 0.015, "C*17:01": 0.012,
    "DRB1*07:01": 0.100, "DRB1*15:01": 0.080, "DRB1*03:01": 0.075, "DRB1*04:01": 0.065, "DRB1*01:01": 0.060, "DRB1*13:01": 0.050,
    "DRB1*11:01": 0.045, "DRB1*04:04": 0.035, "DRB1*08:01": 0.030, "DRB1*12:01": 0.028, "DRB1*14:01": 0.025, "DRB1*09:01": 0.022,
    "DRB1*13:02": 0.020, "DRB1*11:04": 0.018, "DRB1*04:05": 0.016, "DRB1*10:01": 0.015, "DRB1*16:01": 0.014, "DRB1*15:03": 0.012,
    "DQB1*03:01": 0.130, "DQB1*02:01": 0.110, "DQB1*06:02": 0.080, "DQB1*05:01": 0.075, "DQB1*03:02": 0.060, "DQB1*06:03": 0.045,
    "DQB1*03:03": 0.040, "DQB1*04:02": 0.035, "DQB1*05:03": 0.025, "DQB1*06:04": 0.020, "DQB1*02:02": 0.018,
    "DQA1*01:01": 0.110, "DQA1*05:01": 0.100, "DQA1*01:02": 0.090, "DQA1*03:01": 0.080, "DQA1*02:01": 0.070, "DQA1*01:03": 0.050,
    "DQA1*04:01": 0.035, "DQA1*05:05": 0.025, "DQA1*06:01": 0.015,
    "DPA1*01:03": 0.300, "DPA1*02:01": 0.200, "DPA1*01:01": 0.150, "DPA1*02:02": 0.080, "DPA1*03:01": 0.050,
    "DPB1*04:01": 0.200, "DPB1*04:02": 0.120, "DPB1*02:01": 0.100, "DPB1*01:01": 0.080, "DPB1*03:01": 0.060, "DPB1*05:01": 0.040,
    "DPB1*13:01": 0.030, "DPB1*06:01": 0.025, "DPB1*14:01": 0.020,
}
FREQUENCY_FLOOR = 1e-5
