"""Closed vocabularies and thresholds. All of them are fixed values that results depend on."""

# Auxiliaries, pronouns and tense-aspect-modality (TAM) labels.
MODALS = ["can", "could", "will", "would", "shall", "should", "may", "might", "must", "ought"]
PRONOUNS = ["it", "they", "we", "you", "i", "he", "she", "this", "that", "these", "those"]
RELATIVE_PRONOUNS = ["which", "that", "who", "whom", "whose", "where", "when"]
EXPLETIVES = ["there", "it"]
VALID_TAM = ["pres-be", "past-be", "perf-be", "modal-be", "prog-be"]
INVALID_TAM = ["get-be", "unknown"]
SUBJECT_TYPES = ["DEF_NP", "INDEF_NP", "PL_NP", "PROPN", "PRON", "REL", "EXPL"]
DEFINITE = ["the", "this", "that", "these", "those"]
INDEFINITE = ["a", "an", "some", "any"]

# Markers of an extraposed clause, and the place that one must lie beyond.
EXTRAPOSITION_MARKERS = [" that ", " whether ", " if ", " to ", " how ", " what ", " when ", " where ", " why "]
EXTRAPOSITION_BEYOND = 8

# Misspelled prepositions and their forms.
PREP_CORRECTIONS = {
    "form": "from", "fro": "from", "frm": "from", "fom": "from",
    "amangst": "amongst", "amoungst": "amongst", "amongts": "amongst",
    "thorughout": "throughout", "throghout": "throughout", "throught": "through", "thru": "through", "trough": "through", "throug": "through",
    "whithin": "within", "witin": "within", "withing": "within",
    "whit": "with", "wiht": "with", "wth": "with", "wit": "with",
    "withiout": "without", "whitout": "without", "withou": "without", "whithout": "without",
    "arround": "around", "aroud": "around", "aorund": "around",
    "inspite": "despite",
    "tot": "to", "ot": "to",
    "upto": "up",
    "ion": "in",
    "towars": "towards", "towardas": "towards", "toward": "towards",
    "betwee": "between", "beetween": "between",
    "againts": "against", "agains": "against",
    "untill": "until", "util": "until",
    "accross": "across", "acros": "across",
    "behing": "behind", "behinde": "behind",
    "besid": "beside", "bside": "beside",
    "beneth": "beneath", "beneith": "beneath",
    "abov": "above", "abve": "above",
    "belo": "below", "belwo": "below",
    "alon": "along", "alnog": "along",
    "nea": "near", "naer": "near",
    "outsid": "outside", "outisde": "outside",
    "insid": "inside", "insdie": "inside",
    "beyon": "beyond", "beyound": "beyond",
    "oposite": "opposite", "opposit": "opposite",
    "beneat": "beneath",
    "througout": "throughout",
    "althrough": "although",
}

# What is tagged as a preposition but is none.
INVALID_PREPS = ["tooin", "notin", "forwhy", "languageas", "appropriatelyas", "againstin", "withapart", "notwithstanding", "ie", "eg", "a", "o", "although", "althrough", "per"]

# Prepositions that a correction may lead to.
VALID_PREPOSITIONS = [
    "about", "above", "across", "after", "against", "along", "alongside", "amid", "amidst", "among", "amongst", "around", "as", "at",
    "before", "behind", "below", "beneath", "beside", "besides", "between", "beyond", "by",
    "concerning",
    "despite", "down", "during",
    "except", "excluding",
    "following", "for", "from",
    "in", "inside", "into",
    "like",
    "near", "notwithstanding",
    "of", "off", "on", "onto", "opposite", "out", "outside", "over",
    "past", "pending", "per", "plus",
    "regarding", "round",
    "since",
    "than", "through", "throughout", "till", "to", "toward", "towards",
    "under", "underneath", "unlike", "until", "up", "upon",
    "versus", "via",
    "with", "within", "without",
]

# Verb lemmas that are replaced by others.
VERB_CORRECTIONS = {
    "highlightene": "highlight", "instutationalize": "institutionalize", "welcomme": "welcome", "surpresse": "suppress", "exggrate": "exaggerate",
    "borderd": "border", "hypnose": "hypnotize", "summorise": "summarise", "entitele": "entitle", "convinse": "convince", "consule": "consult",
    "elecete": "elect", "shattre": "shatter", "proclame": "proclaim", "selebrate": "celebrate", "accure": "occur", "headhunte": "headhunt",
    "devorte": "divorce", "preceede": "precede", "threathene": "threaten", "restablishe": "reestablish", "challege": "challenge",
    "supppose": "suppose", "sensibilize": "sensitize", "technolize": "technologize", "bose": "boss",
    "recognise": "recognize", "realise": "realize", "organise": "organize", "summarise": "summarize", "criticise": "criticize",
    "emphasise": "emphasize", "analyse": "analyze", "characterise": "characterize", "specialise": "specialize", "generalise": "generalize",
    "legalise": "legalize", "hospitalise": "hospitalize", "centralise": "centralize", "privatise": "privatize", "socialise": "socialize",
    "maximise": "maximize", "minimise": "minimize", "optimise": "optimize", "incentivise": "incentivize",
    "chose": "choose", "bore": "bear", "wore": "wear", "tore": "tear", "swore": "swear", "froze": "freeze", "spoke": "speak", "broke": "break",
    "woke": "wake", "drove": "drive", "rode": "ride", "wrote": "write", "rose": "rise", "arose": "arise", "strove": "strive", "throve": "thrive",
}

# Participles that a joined word may begin with, in the order in which they are tried, and their verbs.
JOINED_PARTICIPLES = {
    "seen": "see", "been": "be", "gone": "go", "done": "do", "given": "give", "taken": "take", "eaten": "eat", "beaten": "beat",
    "written": "write", "driven": "drive", "risen": "rise",
}
# What the second part of a joined word begins with; consonants that -ed doubles.
JOINED_BEGINNINGS = ["the", "thi", "some", "more", "to", "in", "on", "is", "it", "an", "a"]
DOUBLED = "bdgklmnprst"

# Prepositions of place and direction in a pattern.
SPATIAL = ["up", "over", "above", "around", "towards", "within", "out"]

# Thresholds of the three layers.
ATP, DPB, HR = 0.10, 0.10, 2.8
NPMI, NPMI_DISCOVERY, H_SLOT = 0.05, 0.02, 1.5
G2_NPMI, G2_H_SLOT, NPMI_FLOOR = 3.84, 1.0, 0.0
GRID = {
    "atp": [0.05, 0.08, 0.10, 0.12, 0.15],
    "dpb": [0.05, 0.08, 0.10, 0.12, 0.15],
    "hr": [2.0, 2.5, 2.8, 3.0, 3.5],
    "npmi": [0.02, 0.03, 0.05, 0.08, 0.10],
    "h_slot": [1.0, 1.25, 1.5, 1.75, 2.0],
}
