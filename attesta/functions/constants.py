"""Fixed values.

Word lists, patterns and thresholds that define the results.  They are plain
data in natural order; the logic that uses them lives elsewhere.
"""

# --- fixed values: abbreviations that do not end a sentence -----------------
ABBREVIATIONS = [
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "etc", "Jan", "Feb", "Mar",
    "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "approx", "appt", "Dept", "No",
    "Vol", "Fig",
]

# --- fixed values: patterns of notes, headers and transcripts ---------------
BULLET_MARKS = "-•*#+"
BULLETS = f"^[{BULLET_MARKS}]+"
FIELD_PREFIX = "^[A-Za-z /-]+:\\s*"
TEMPLATE_JUNK = "(?i)\\[unknown\\]|\\[not mentioned\\]"
SECTION_HEADER = (
    "Subjective|Objective|Assessment\\s*(?:/\\s*Problem\\s*List)?|Assessment|"
    "Problem\\s*List|Plan|Follow[- ]?up"
)
SECTION_NAMES = ["subjective", "objective", "assessment", "plan", "followup"]
LINE_SECTIONS = [
    ("subjective", "^subjective|^hpi|^history of present|^review of systems|^ros"
                   "|^past medical|^pmh|^social history|^family history"
                   "|^current medications|^medications|^allergies"),
    ("objective", "^objective|^vital|^physical exam|^pe\\b|^test results|^labs|^imaging|^results"),
    ("assessment", "^assessment|^problem list|^impression|^diagnosis"),
    ("plan", "^plan|^follow.?up|^orders|^disposition"),
]
HEADER_MAX_CHARS = 50
TABLE_SECTIONS = ["Subjective", "Objective", "Assessment", "Plan", "Follow-up"]
TABLE_HEADER = "(?i)^(subjective|objective|assessment|plan|follow.?up)[:\\s]"
BARE_HEADER = (
    "(?i)^(?:here is the soap note based on the transcript:|subjective:|objective:|"
    "assessment(?: / problem list)?:|problem list:|plan:|follow-?up:|instructions:)\\s*$"
)
STRUCTURAL_LABEL = (
    "(?i)^(Subjective|Objective|Assessment\\s*(/\\s*Problem\\s*List)?|Problem\\s*List"
    "|Plan|Follow[- ]?up|HPI|Current\\s*medications?|Review\\s*of\\s*systems?"
    "|Vital\\s*signs?|Physical\\s*exam?|Test\\s*Results?)\\s*:?\\s*$"
    "|^Here\\s+is\\s+the\\s+SOAP.*:\\s*$"
)
INLINE_HEADER = "(?i)(SUBJECTIVE|OBJECTIVE|ASSESSMENT|PLAN|S:|O:|A:|P:)"
SPEAKER_TAG = "(?i)^\\s*\\[(?:doctor|patient|clinician|nurse)[^\\]]*\\]\\s*"
TURN_TAG = "(?i)\\[(?:doctor|patient)\\]"
CONJUNCTION = (
    "(?i)^(and|also|however|additionally|furthermore|moreover|in addition|but|or|nor|so|yet)\\b"
)
NEGATION = "(?i)\\b(?:no|not|denies?|denied|without|negative for|absence of)\\b"
NUMBER = "(?i)\\d+(?:[./]\\d+)?(?:mg|mcg|ml|kg|lb|bpm|%)?"
DOSE = "(?i)^\\d+(?:\\.\\d+)?(?:mg|mcg|g|ml|mm|cm|kg|lb|l|bpm|%)$"
ALNUM_CODE = "^(?:[A-Za-z]*\\d+[A-Za-z]*|[A-Za-z]+-[A-Za-z0-9]+)$"
WORD = "[a-z0-9]+(?:'[a-z]+)?"
PLAIN_WORD = "[a-z0-9']+"
CAP_WORD = "[A-Z][a-zA-Z]+"
TOKEN = "[A-Za-z][A-Za-z'-]*|\\d[\\d./%-]*"
LIST_MARK = "^[-•*0-9.) ]+"

# --- fixed values: stop lists ----------------------------------------------
FUNCTION_WORDS = (
    "a an the and or but nor so yet if then than as that this these those there here "
    "i me my we us our you your he him his she her it its they them their who whom "
    "whose which what is am are was were be been being have has had having do does did "
    "doing will would shall should can could may might must to of in on at by for with "
    "about against between into through during before after above below from up down out "
    "off over under again further not no own same just also"
).split()
CLINICAL_FILLER = (
    "patient patients doctor symptom symptoms report reports reported present presents "
    "presented mention mentioned state stated current medication medications history review "
    "system assessment problem list objective subjective plan follow followup test result "
    "results physical exam vital signs sign issue deny denied denies note noted admit "
    "admitted endorse endorsed complain complained"
).split()
POSSESSIVE_EXTRA = "mine ours yours hers theirs once".split()
NAME_STOP = (
    "the he she his her patient objective subjective assessment plan follow followup review "
    "current past test vital physical problem list hpi pmh ros i medications results history "
    "exam signs systems"
).split()
FACT_STOP = (
    "patient doctor symptom report present mention state current medication history review "
    "system assessment problem list objective subjective plan follow followup test result "
    "physical exam vital sign issue deny note admit endorse complain"
).split()
TIMING_WORDS = (
    "once twice thrice daily weekly monthly nightly hourly bid tid qid qhs qd prn morning "
    "evening bedtime night"
).split()
CUE_WORDS = (
    "abi a1c mri ct xray x-ray ultrasound pft pt l5 mtp dorsiflexion angioedema stridor "
    "wheezing osteomyelitis meloxicam singulair albuterol clindamycin asthma diabetes ulcer "
    "debridement immunotherapy"
).split()
GENERIC_ENTITIES = "pain rash fever nausea vomiting diarrhea swelling infection ulcer".split()
HEDGE_WORDS = (
    "maybe perhaps might could possibly probably think feel seem appears suggest sometimes "
    "often usually generally"
).split()
NEGATION_WORDS = "not no never none neither nor without n't nobody nothing nowhere".split()

# --- fixed values: content-type lexicon ------------------------------------
CONTENT_HEADERS = [
    "subjective", "subjective continued", "objective", "assessment",
    "assessment / problem list", "plan", "hpi", "history of present illness",
    "past medical history", "review of systems", "physical exam", "physical examination",
    "vital signs", "current medications", "current medication", "problem list",
    "test results", "test result", "allergies", "social history", "family history",
    "chief complaint", "here is the soap note", "heart exam", "lung exam",
    "lower extremity exam", "head and neck", "abdomen", "extremities", "heart", "lungs",
    "temperature", "pulse", "pulse rate", "respirations", "respiratory rate",
    "blood pressure", "oxygen saturation", "weight", "jugular venous distention",
    "carotid bruits", "echo", "ekg", "ecg",
]
MEDICATION_TERMS = [
    "tylenol", "acetaminophen", "advil", "motrin", "ibuprofen", "aspirin", "naproxen", "aleve",
    "amoxicillin", "augmentin", "azithromycin", "zithromax", "penicillin", "cephalexin",
    "ciprofloxacin", "doxycycline", "clindamycin", "metronidazole", "bactrim", "lisinopril",
    "losartan", "amlodipine", "metoprolol", "atenolol", "carvedilol", "hydrochlorothiazide",
    "furosemide", "lasix", "atorvastatin", "lipitor", "simvastatin", "rosuvastatin", "crestor",
    "metformin", "glipizide", "insulin", "lantus", "humalog", "januvia", "albuterol",
    "ventolin", "proair", "symbicort", "advair", "singulair", "montelukast", "flonase",
    "fluticasone", "prednisone", "prednisolone", "omeprazole", "prilosec", "pantoprazole",
    "ranitidine", "famotidine", "pepcid", "gabapentin", "neurontin", "duloxetine", "cymbalta",
    "sertraline", "zoloft", "fluoxetine", "prozac", "escitalopram", "lexapro", "citalopram",
    "bupropion", "wellbutrin", "trazodone", "alprazolam", "xanax", "lorazepam", "ativan",
    "diazepam", "valium", "clonazepam", "klonopin", "adderall", "ritalin", "methylphenidate",
    "amphetamine", "warfarin", "coumadin", "eliquis", "apixaban", "xarelto", "rivaroxaban",
    "plavix", "clopidogrel", "levothyroxine", "synthroid", "benadryl", "diphenhydramine",
    "claritin", "loratadine", "zyrtec", "cetirizine", "oxycodone", "percocet", "hydrocodone",
    "vicodin", "norco", "morphine", "methadone", "naltrexone", "buprenorphine", "suboxone",
    "tramadol", "methotrexate", "hydroxychloroquine", "plaquenil", "nsaid", "nsaids",
    "statin", "opioid", "opioids", "antibiotic", "antibiotics", "steroid", "steroids",
    "beta blocker", "ace inhibitor",
]
MEDICATION_SUFFIXES = [
    "cillin", "mycin", "oxacin", "azole", "statin", "olol", "pril", "sartan", "zepam",
    "zolam", "profen", "codone", "dipine", "tidine", "prazole", "triptan", "barbital",
]
CONDITION_TERMS = [
    "fever", "cough", "shortness of breath", "dyspnea", "chest pain", "headache", "migraine",
    "nausea", "vomiting", "diarrhea", "constipation", "fatigue", "dizziness", "vertigo",
    "rash", "swelling", "edema", "numbness", "tingling", "weakness", "fracture", "sprain",
    "strain", "infection", "pneumonia", "bronchitis", "asthma", "copd", "diabetes",
    "hypertension", "hypotension", "arrhythmia", "anxiety", "depression", "insomnia",
    "obesity", "arthritis", "osteoarthritis", "rheumatoid arthritis", "concussion",
    "sinusitis", "uti", "urinary tract infection", "otitis", "conjunctivitis", "dermatitis",
    "eczema", "psoriasis", "cancer", "tumor", "stroke", "seizure", "epilepsy", "withdrawal",
    "addiction", "macromastia", "bruising", "nosebleed", "sore throat", "ear infection",
    "pink eye", "reflux", "gerd", "ulcer", "anemia", "palpitations", "murmur",
    "hyperlipidemia", "hypothyroidism", "hyperthyroidism", "gout", "sciatica",
]
CONDITION_SUFFIXES = ["itis", "osis", "emia", "algia", "opathy", "oma", "plegia"]
PROCEDURE_TERMS = [
    "x-ray", "xray", "ct scan", "mri", "ultrasound", "biopsy", "ekg", "ecg", "echocardiogram",
    "colonoscopy", "endoscopy", "surgery", "intubation", "catheter", "injection",
    "vaccination", "vaccine", "immunization", "physical therapy", "skin testing",
    "blood test", "blood work", "lab work", "labs", "screening", "mammogram", "pap smear",
    "dialysis", "chemotherapy", "radiation", "transplant", "amputation", "incision",
    "suture", "splint", "cast", "sling", "stitches", "vasectomy", "circumcision", "stent",
    "angioplasty", "pacemaker", "bypass",
]
PROCEDURE_SUFFIXES = ["ectomy", "otomy", "oscopy", "ostomy", "plasty", "ography", "centesis"]
PROPER_NOUN_STOP = (
    "the he she his her him they their i a an this that these those there here current review "
    "past test vital physical problem no yes not monday tuesday wednesday thursday friday "
    "saturday sunday january february march april may june july august september october "
    "november december"
).split()

# --- fixed values: entity patterns -----------------------------------------
DOSE_ENTITY = (
    "(?i)\\b[A-Za-z][A-Za-z-]+(?:\\s+[A-Za-z][A-Za-z-]+){0,2}\\s+\\d+(?:\\.\\d+)?\\s*"
    "(?:mg|mcg|μg|g|ml|mEq|mmol|units?|IU|tabs?|capsules?|puffs?)"
)
LAB_ENTITY = (
    "(?i)\\b(?:no\\s+(?:fracture|dislocation|acute\\s+\\w+|significant\\s+\\w+|elevated?\\s+\\w+)|"
    "(?:WBC|RBC|Hgb|Hct|BMP|CMP|CBC|BNP|TSH|HbA1c|eGFR|creatinine|glucose|sodium|potassium|"
    "chloride|bicarbonate|BUN|ALT|AST|ALP|bilirubin|troponin|INR|PT|PTT|proBNP)"
    "(?:\\s*[:-]?\\s*\\d+\\.?\\d*\\s*(?:[a-zA-Z/%]+)?)?)"
)

# --- fixed values: rule-based corruption (pattern, replacement, category) ---
CORRUPTION_RULES = [
    ("albuterol", "salmeterol", "wrong_medication"),
    ("Singulair", "Symbicort", "wrong_medication"),
    ("montelukast", "fluticasone", "wrong_medication"),
    ("metformin", "lisinopril", "wrong_medication"),
    ("lisinopril", "metformin", "wrong_medication"),
    ("atorvastatin", "rosuvastatin", "wrong_medication"),
    ("aspirin", "warfarin", "wrong_medication"),
    ("amoxicillin", "azithromycin", "wrong_medication"),
    ("ibuprofen", "naproxen", "wrong_medication"),
    ("omeprazole", "pantoprazole", "wrong_medication"),
    ("sertraline", "fluoxetine", "wrong_medication"),
    ("10\\s*mg", "20 mg", "wrong_dosage"),
    ("5\\s*mg", "10 mg", "wrong_dosage"),
    ("500\\s*mg", "250 mg", "wrong_dosage"),
    ("20\\s*mg", "40 mg", "wrong_dosage"),
    ("25\\s*mg", "50 mg", "wrong_dosage"),
    ("50\\s*mg", "100 mg", "wrong_dosage"),
    ("asthma", "COPD", "wrong_diagnosis"),
    ("hypertension", "hypotension", "wrong_diagnosis"),
    ("diabetes", "hypothyroidism", "wrong_diagnosis"),
    ("allergic\\s+rhinitis", "chronic sinusitis", "wrong_diagnosis"),
    ("angina", "myocardial infarction", "wrong_diagnosis"),
    ("eczema", "psoriasis", "wrong_diagnosis"),
    ("120\\s*/\\s*80", "180/110", "wrong_vital"),
    ("98\\.6", "101.4", "wrong_vital"),
    ("normal", "elevated", "wrong_finding"),
    ("negative", "positive", "wrong_finding"),
]
CORRUPTION_FALLBACK = (
    " Additionally, patient reports recent chest tightness at rest; "
    "troponin I elevated at 0.8 ng/mL on last draw."
)

# --- fixed values: labels and rubric ---------------------------------------
ERROR_TYPES = ["Fabrication", "Negation", "Causality", "Contextual"]
LIKERT_ITEMS = [
    "citation", "accurate", "thorough", "useful", "organized", "comprehensible", "succinct",
]
RUBRIC_ITEMS = LIKERT_ITEMS + ["abstraction", "synthesized", "voice_summ", "voice_note"]

# --- fixed values: thresholds ----------------------------------------------
WINDOW_SENTENCES = 2
WINDOW_CHARS = 1400
STRIDE_CHARS = 700
SECTION_FALLBACK = 0.5
COSINE_FLOOR = 0.30
COSINE_SUPPORT = 0.95
COSINE_NEGATION = 0.93
COSINE_DUPLICATE = 0.92
MIN_FACT_WORDS = 3

# --- fixed values: rules of Porter's stemmer, with its usual irregular words ---
IRREGULAR_STEMS = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEM_PLURAL = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEM_DOUBLE = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEM_TRIPLE = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEM_DROPPED = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
]
