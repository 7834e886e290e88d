"""Rule tables of query understanding, as fixed values; operators take them as parameters, so other domains bring their own."""

# Patterns of the intents, on lower case, in the order in which they are tried.
URGENT = "convuls|not breath|uncon|severe bleed|collapse|fitting|not waking|emergency"
DEFINE = "(?<![a-z0-9_])what is(?![a-z0-9_])|(?<![a-z0-9_])what are(?![a-z0-9_])|tell me about|explain|define|meaning of"
SCOPE = "what does.{0,20}cover|what topics|what does it include|what is included"
DETAIL = "specific|exact|how much|dosage|dose|how many|quantity|amount|tablet|mg(?![a-z0-9_])|ml(?![a-z0-9_])|administration"
PROCEDURE = "how to|how do i|steps|protocol|process|procedure|method"
REFERRAL = "when to refer|when should|when is it serious|when to send|refer"
AFFIRM = "^yes[.!?]?$|^yes[,.]?\\s*please[.!?]?$|^yeah$|^ok$|^okay$|correct|right|exactly|sure"
NEGATE = "^no[.!?]?$|not that|wrong|different|other|else"
GREETING = "^(hi|hello|good morning|good afternoon|salam|ẹ káàbọ̀|ndewo)[\\s!.?]*$"
INTENTS = [("URGENT", URGENT), ("DETAIL", DETAIL), ("REFERRAL", REFERRAL), ("PROCEDURE", PROCEDURE), ("SCOPE", SCOPE), ("DEFINE", DEFINE), ("GREETING", GREETING), ("AFFIRM", AFFIRM), ("NEGATE", NEGATE)]

# Verbs that make a question of a heading, and how a question begins.
VERBS = "is are was were do does did what how when where why tell explain give show meant said tried asked thinking want need got referring talking mean know think".split()
QUESTION_START = "^(what|how|when|where|why|who|which|can|should|does)"

# Moods by pattern on lower case, in order.
SENTIMENTS = [
    ("panic", "urgent|emergency|dying|help me|please|scared|worried|afraid|crisis"),
    ("confused", "don.t understand|not clear|what do you mean|confused|again|repeat"),
    ("affirm", "thanks|thank you|good|got it|understood|ok|noted|clear"),
]

# Pieces of words by which a language is told; the order of the languages settles ties.
LANGUAGE_MARKERS = {
    "ha": "yaya yadda wane wanda alamun alamomin adadin maganin yara jariri ciwon zazzabin cizon sauro hatsari cututtukan jiki fara ake".split(),
    "yo": "bawo ṣe le bẹrẹ itọju ami aisan iba iwọn oogun ọmọde ewu tuntun àti àwọn ni ní sí".split(),
    "ig": "kedu ka esi amalite ọgwụgwọ ihe ngosi nke ọrịa usoro maka ụmụaka ize ndụ ọhụrụ amụrụ na bụ".split(),
    "pid": [*"wetin pikin dey palava wahala abi shey una".split(), "no be"],
}
# Words by which a mode of speech is told.
PIDGIN_WORDS = "na wetin dey don waka pikin small fit".split()
ENGLISH_WORDS = "what how when where should can would could".split()

# Topics to analytics categories, in order.
CATEGORIES = [
    ("malaria", "malaria"),
    ("diarrhea", "diarr?h?oea|diarrhea"),
    ("pneumonia", "pneumonia|chest|cough"),
    ("fever", "fever|temperature"),
    ("nutrition", "nutrition|malnutrition|feeding"),
    ("immunization", "immunization|vaccine|vaccination"),
    ("newborn_care", "newborn|neonate|baby"),
    ("maternal_health", "maternal|pregnancy|antenatal|postnatal"),
    ("tb", "tuberculosis|tb(?![a-z0-9_])"),
    ("hiv", "hiv|aids|art(?![a-z0-9_])"),
    ("covid", "covid|corona|sars"),
]

# What is out of scope, by pattern on lower case.
OUT_OF_SCOPE = [
    "capital\\s+of\\s+(nigeria|country|city)",
    "weather\\s+(forecast|today|tomorrow)",
    "sports?\\s+(score|game|match)",
    "politics?|election|president|government",
    "diabetes\\s+(management|treatment|control)",
    "cancer\\s+(treatment|therapy|management)",
    "hypertension\\s+(management|treatment)",
    "entertainment|movie|music|celebrity",
    "cooking|recipe|food\\s+preparation",
]

# Short forms and the terms that they add to a query.
EXPANSIONS = {
    "arv": "antiretroviral",
    "pmtct": "prevention mother child transmission pregnancy maternal",
    "tpt": "preventive isoniazid rifapentine tuberculosis",
    "ipt": "isoniazid preventive tuberculosis",
    "tb": "tuberculosis coinfection",
    "act": "artemisinin coartem lumefantrine malaria",
    "kmc": "kangaroo mother care skin",
    "plhiv": "people living hiv positive",
    "pph": "postpartum hemorrhage bleeding",
    "anc": "antenatal pregnancy",
    "dtg": "dolutegravir",
    "inh": "isoniazid",
    "3hp": "isoniazid rifapentine preventive",
    "3hr": "isoniazid rifampicin preventive",
    "6h": "isoniazid preventive",
    "sti": "sexually transmitted infection",
    "imnci": "integrated neonatal childhood illness",
    "ors": "oral rehydration",
    "pregnant": "pregnancy maternal pmtct",
    "failure": "virologic viral load resistance",
    "coinfection": "co-infection",
    "complicated": "severe",
    "mrdt": "malaria rapid test rdt",
    "preventive": "isoniazid tpt",
    "therapy": "treatment regimen",
}

# How an age is told without a number: pattern, what it must not go with, label, months.
AGE_WORDS = [
    ("neonate|newborn|born\\s*baby|just\\s*born", None, "newborn", 0),
    ("infant|baby", None, "infant", 6),
    ("pikin|pekin|pickin|toddler|young child", None, "child", 36),
    ("child|kid", "adult|woman|man|mother|father", "child", 48),
]
# Intents as analytics name them.
INTENT_GROUPS = {"PROCEDURE": "treatment_dosage", "DETAIL": "treatment_dosage", "CLINICAL": "symptom_check", "URGENT": "referral_criteria"}

# How a message corrects another one (what it names, how it turns, a plain denial), how an age and a weight are told; on lower case.
CORRECTED = "(?:meant?|mean|it'?s|actually|rather)\\s+(.+?)[\\s.!?]*$"
CORRECTS = "^(?:no|not|nope|sorry|actually)\\s*[,.]?\\s*(?:i\\s*(?:meant?|mean|was\\s*(?:talking|asking|referring))|it'?s\\s*(?:not|actually)|(?:not\\s+)?(?:\\w+)[,.]?\\s*(?:i\\s*mean|actually|rather))"
DENIES = "^(?:no|not|nope|actually|sorry)\\s+(?!that\\b)(\\w[\\w\\s]{2,30})$"
AGE = "(\\d+)\\s*(year|month|week|day|yr|mo|wk|dy)s?\\s*old"
WEIGHT = "(\\d+(?:\\.\\d+)?)\\s*(kg|kilos?|kgs)"

# How a patient is spoken of, and how general information is asked for; words on lower case.
PATIENT_WORDS = "patient baby child mother pikin kg pregnant she he her him infant toddler boy girl".split() + ["the woman", "the man", "years? old", "months? old", "weeks? old", "days? old"]
INFORMATIONAL = ["what is", "what are", "what does", "define", "explain", "tell me about", "coverage", "insurance", "nhis", "scheme", "eligibility", "accreditation", "registration", "requirements", "how to register", "how to enroll"]
PEDIATRIC = ["baby", "infant", "child", "pikin", "toddler", "neonate", "newborn", "boy", "\\d+\\s*(?:year|month|week|day)s?\\s*old"]

# Danger signs by pattern on lower case, in order, and what each is of.
DANGER_SIGNS = [
    ("convulsions", "convuls|fitting|seizure"),
    ("unconsciousness", "unconscious|not responding|unresponsive|lethargi"),
    ("unable to drink", "(?:unable|cannot|can'?t|not able)\\s*(?:to\\s*)?(?:drink|breastfeed|eat|swallow)"),
    ("severe bleeding", "(?:severe|heavy|massive)\\s*bleed"),
    ("breathing failure", "not\\s*breath|stopped?\\s*breath|apn[oe]a|blue|cyanosis"),
    ("shock", "shock|weak\\s*pulse|cold\\s*extremit"),
]

# What a failed compilation left in place of an answer; ways of asking back instead of answering, on lower case.
COMPILER_ERRORS = ["does not contain any meaningful information", "no meaningful information to process", "provided text does not contain"]
DEFLECTIONS = ["tell me more about your (?:patient|role|situation|query)", "tell me what (?:type|kind|aspect|specific)", "what specific (?:aspect|type|area|information)", "can you (?:tell me|provide) more (?:about|details)", "please (?:tell me|provide|share) more"]
