"""Fixed values that results depend on."""

# fixed values: sensitivity levels, lowest first
SENSITIVITY = ["open", "internal", "confidential", "restricted"]

# fixed values: high-frequency words for the vote between languages in Latin script
STOP_WORDS = {
    "eng": "the and of to in is for with on this that be are from or as it not by at an was have has will each which their there".split(),
    "fra": "le la les de des du et un une est pour dans sur que qui vous ne pas ce avec sont votre être par plus tout mais nous aux".split(),
    "deu": "der die das und ist nicht mit ein eine den von zu im für auf werden sie dem des sich bei oder wird nur auch nach".split(),
    "spa": "el los las de del y es en un una para con que no por se al como más este esta sobre cuando hay pero".split(),
    "ita": "il lo gli di del della e è un una per con che non sono nel alla questo come anche più dalla sulla ma".split(),
}

# fixed values: terms of health records, strong ones first to match
PHI_STRONG = [
    "medical record number", "mrn", "patient name", "icd-10", "icd10", "hipaa", "protected health information",
    "diagnosis code", "discharge summary", "prescription", "dosage", "patient id", "date of birth",
]
PHI_WEAK = ["patient", "diagnosis", "clinical", "physician", "symptom", "treatment plan", "medical history", "lab result"]

# fixed values: words that are never taken for garble
COMMON_WORDS = """
the of and to in a is that for it as was with be by on not he this are or his
from at which but have an they you were her she all there their one we him been
has when who will no more if out so up said what its about than into them can
only other time new some could these two may first then do any like my now over
such our man me even most made after also did many off before must well back
through years where much your way down should because each just those people how
too little good make world still see own men work long here get both between life
being under never day same another know while last might us great old year come
since against go came right used take three page section figure table manual
board power supply circuit signal voltage input output ground test adjust check
replace remove install connect wire switch control game play coin monitor video
sound amplifier transistor resistor capacitor diode assembly parts list number
""".split()

# fixed values: image fidelity
DPI_TARGET_SCHEMATIC, DPI_TARGET_TEXT, DPI_MAX_POINTS = 300.0, 220.0, 40.0
DPI_LOW, DPI_LOW_POINTS = 150.0, 10.0
SHARPNESS_MIN, SHARPNESS_POINTS = 120.0, 15.0
SPECKLE_MAX, SPECKLE_POINTS = 6.0, 8.0
SKEW_MAX, SKEW_POINTS = 1.5, 6.0
ONE_BIT_POINTS = 12.0

# fixed values: text quality
CONF_TARGET, CONF_MAX_POINTS = 80.0, 30.0
LOW_CONF, LOW_FRACTION_TARGET, LOW_FRACTION_FULL, LOW_FRACTION_POINTS = 60.0, 0.15, 0.50, 15.0
SMALL_TEXT_PX, SMALL_CONF_MIN, SMALL_POINTS = 18.0, 70.0, 10.0
REFDES_CONF_MIN, REFDES_POINTS = 75.0, 12.0
GARBLE_MAX_POINTS, GARBLE_FULL, GARBLE_SUSPECT = 40.0, 0.8, 0.30

# fixed values: roll-up, grades, gates, sampling, chunking, ranking
IMAGE_ADEQUATE, TEXT_ADEQUATE = 75.0, 70.0
GRADES = [("A", 88.0), ("B", 78.0), ("C", 68.0), ("D", 55.0)]
GATE_BLOCK = 50.0
SCREENING_PAGES = 16
CHUNK_TOKENS, CHUNK_OVERLAP = 800, 100
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
RENDER_DPI, RENDER_MEGAPIXELS = 300.0, 45.0
