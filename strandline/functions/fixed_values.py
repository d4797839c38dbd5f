"""Lists that results depend on word for word."""

# Words that mark a Cas gene.
CAS_KEYWORDS = (
    "cas1", "cas2", "cas4", "cas3", "cas5", "cas6", "cas7", "cas8", "cas9", "cpf1", "cas12", "cas10",
    "csm", "cmr", "cas13", "c2c2", "crispr-associated", "crispr associated",
)

# Words that mark a repeat region as a CRISPR array.
REPEAT_KEYWORDS = ("crispr", "direct repeat", "palindromic repeat")

# Marker genes of the core panel and their products.
CORE_MARKERS = {
    "rpsB": "30S ribosomal protein S2",
    "rpsC": "30S ribosomal protein S3",
    "rpsD": "30S ribosomal protein S4",
    "rpsE": "30S ribosomal protein S5",
    "rpsG": "30S ribosomal protein S7",
    "rpsH": "30S ribosomal protein S8",
    "rpsI": "30S ribosomal protein S9",
    "rpsJ": "30S ribosomal protein S10",
    "rpsK": "30S ribosomal protein S11",
    "rpsL": "30S ribosomal protein S12",
    "rpsM": "30S ribosomal protein S13",
    "rplA": "50S ribosomal protein L1",
    "rplB": "50S ribosomal protein L2",
    "rplC": "50S ribosomal protein L3",
    "rplD": "50S ribosomal protein L4",
    "rplE": "50S ribosomal protein L5",
    "rplF": "50S ribosomal protein L6",
    "rplK": "50S ribosomal protein L11",
    "rplL": "50S ribosomal protein L12",
    "rplN": "50S ribosomal protein L14",
    "rplP": "50S ribosomal protein L16",
    "rplR": "50S ribosomal protein L18",
    "rplV": "50S ribosomal protein L22",
    "rplW": "50S ribosomal protein L23",
}

# Marker genes of the housekeeping panel and their products.
HOUSEKEEPING_MARKERS = {
    "recA": "DNA recombinase A",
    "gyrB": "DNA gyrase subunit B",
    "rpoB": "RNA polymerase subunit beta",
    "dnaK": "DnaK chaperone",
    "groEL": "GroEL chaperonin (Hsp60)",
    "tsf": "elongation factor Ts",
    "tuf": "elongation factor Tu",
    "fusA": "elongation factor G",
}

# Steps of each pathway with the references of which one is enough.
PATHWAYS = {
    "Glycolysis (Embden-Meyerhof)": [
        ("Glucokinase / Hexokinase", ["K00845", "K00844", "EC:2.7.1.2", "EC:2.7.1.1"]),
        ("Phosphoglucose isomerase", ["K01810", "EC:5.3.1.9"]),
        ("6-Phosphofructokinase", ["K00850", "K21071", "EC:2.7.1.11"]),
        ("Fructose-bisphosphate aldolase", ["K01623", "K01624", "K11645", "EC:4.1.2.13"]),
        ("Triosephosphate isomerase", ["K01803", "EC:5.3.1.1"]),
        ("Glyceraldehyde-3-phosphate dehydrogenase", ["K00134", "K10705", "EC:1.2.1.12"]),
        ("Phosphoglycerate kinase", ["K00927", "EC:2.7.2.3"]),
        ("Phosphoglycerate mutase", ["K01834", "K01837", "K15633", "EC:5.4.2.11", "EC:5.4.2.12"]),
        ("Enolase", ["K01689", "EC:4.2.1.11"]),
        ("Pyruvate kinase", ["K00873", "EC:2.7.1.40"]),
    ],
    "TCA Cycle": [
        ("Citrate synthase", ["K01647", "K01659", "EC:2.3.3.1", "EC:2.3.3.5", "EC:2.3.3.16"]),
        ("Aconitate hydratase", ["K01681", "K01682", "EC:4.2.1.3"]),
        ("Isocitrate dehydrogenase", ["K00031", "K00030", "EC:1.1.1.42", "EC:1.1.1.41"]),
        ("2-Oxoglutarate dehydrogenase", ["K00164", "K00174", "EC:1.2.4.2", "EC:1.2.7.3"]),
        ("Succinyl-CoA synthetase", ["K01899", "K01900", "K01902", "EC:6.2.1.4", "EC:6.2.1.5"]),
        ("Succinate dehydrogenase", ["K00234", "K00235", "K00236", "K00237", "EC:1.3.5.1"]),
        ("Fumarate hydratase", ["K01676", "K01677", "K01678", "K01679", "EC:4.2.1.2"]),
        ("Malate dehydrogenase", ["K00024", "K00025", "K00026", "EC:1.1.1.37", "EC:1.1.1.38", "EC:1.1.5.4"]),
    ],
    "Glyoxylate Bypass": [
        ("Isocitrate lyase", ["K01637", "EC:4.1.3.1"]),
        ("Malate synthase", ["K01638", "EC:2.3.3.9"]),
    ],
    "Fatty Acid Beta-Oxidation": [
        ("Acyl-CoA synthetase", ["K01897", "EC:6.2.1.3"]),
        ("Acyl-CoA dehydrogenase", ["K00249", "K00248", "K00255", "EC:1.3.8.7", "EC:1.3.8.1", "EC:1.3.8.8"]),
        ("Enoyl-CoA hydratase", ["K01692", "EC:4.2.1.17"]),
        ("3-Hydroxyacyl-CoA dehydrogenase", ["K00022", "EC:1.1.1.35"]),
        ("Acetyl-CoA C-acyltransferase (thiolase)", ["K00632", "EC:2.3.1.16"]),
    ],
}

# Discovery rule sets as (id, category, weight, terms).
RULESETS = {
    "mobilome": [
        ("integrase", "Mobilome: Integrase", 3, ["integrase", "site-specific integrase", "tyrosine recombinase", "xerC", "xerD"]),
        ("transposase", "Mobilome: Transposon", 3, ["transposase", "insertion element", "IS element", "IS3", "IS4", "IS5", "IS6", "IS21", "IS256", "IS110"]),
        ("resolvase", "Mobilome: Recombinase", 2, ["resolvase", "recombinase", "site-specific recombinase"]),
        ("phage", "Mobilome: Phage", 2, ["phage", "prophage", "tail protein", "capsid", "portal protein", "terminase", "holin"]),
        ("conjugation", "Mobilome: Conjugation", 3, ["traA", "traB", "traC", "traD", "traE", "traG", "traI", "traK", "mobA", "mobB", "relaxase", "type IV secretion"]),
    ],
    "xenobiotics": [
        ("alkane_monooxygenase", "Alkane Degradation", 3, ["alkB", "ladA", "alkane monooxygenase", "rubredoxin", "rubredoxin reductase"]),
        ("aromatic_dioxygenase", "Aromatic Ring Cleavage", 3, ["catechol 1,2-dioxygenase", "catechol 2,3-dioxygenase", "protocatechuate 3,4-dioxygenase", "protocatechuate 4,5-dioxygenase", "pcaG", "pcaH", "catA"]),
    ],
}

# Keys of an annotation summary report and the metric that each names.
SUMMARY_KEYS = {
    "size": "genome_size_bp", "length": "genome_size_bp", "gc": "gc_content", "gc content": "gc_content",
    "cdss": "cds", "trnas": "trna", "tmrnas": "tmrna", "rrnas": "rrna", "ncrnas": "ncrna",
    "ncrna regions": "regulatory", "crispr arrays": "crispr", "pseudogenes": "pseudogene",
    "sorfs": "sorf", "orics": "oric", "orivs": "oriv", "orits": "orit",
}

# A line of an annotation summary report.
SUMMARY_LINE = r"(?i)^\s*([^:]+):\s*([\d,.]+)\s*(?:bp|%)?\s*$"

# The source column of GFF3 rows.
GFF_SOURCE = "genbank_gff"

# Columns of the batch summary.
BATCH_COLUMNS = (
    "Sample / Isolate", "Genome Size (Mbp)", "Total Gene/Feature Count", "G + C content (%)", "CDS", "rRNA",
    "tRNA / tmRNA", "Genes assigned to UniRef", "Genes assigned to RefSeq", "Genes assigned to COGs",
    "Genes assigned to KEGG/KO", "Genes without function prediction", "Pseudogenes", "Regulatory ncRNAs",
)

# Suffixes of annotation flatfiles.
FLATFILE_SUFFIXES = (".gbff", ".gbk", ".gb")

# The standard genetic code in TCAG order, and the codons in which the other NCBI tables differ.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE_CHANGES = {
    1: "", 2: "AGA* AGG* ATAM TGAW", 3: "ATAM CTTT CTCT CTAT CTGT TGAW", 4: "TGAW", 5: "AGAS AGGS ATAM TGAW",
    6: "TAAQ TAGQ", 9: "AAAN AGAS AGGS TGAW", 10: "TGAC", 11: "", 12: "CTGS", 13: "AGAG AGGG ATAM TGAW",
    14: "AAAN AGAS AGGS TAAY TGAW", 15: "TAGQ", 16: "TAGL", 21: "TGAW ATAM AGAS AGGS AAAN", 22: "TCA* TAGL",
    23: "TTA*", 24: "AGAS AGGK TGAW", 25: "TGAG", 26: "CTGA", 27: "TAAQ TAGQ TGAW", 28: "TAAQ TAGQ TGAW",
    29: "TAAY TAGY", 30: "TAAE TAGE", 31: "TAAE TAGE TGAW", 32: "TAGW", 33: "TAAY TGAW AGAS AGGK",
}
# Codons that are stops as well as sense codons.
DUAL_STOPS = {27: ("TGA",), 28: ("TAA", "TAG", "TGA"), 31: ("TAA", "TAG")}

# Bases of each IUPAC letter.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
