"""Lists, tables, patterns and formats that results depend on."""

# Closed sets of the concept model.
CATEGORIES = ("finding", "symptom", "disorder", "behavior", "observable_entity", "assessment_scale")
PREDICATES = ("is_a", "has_associated_finding", "has_interpretation", "measures", "is_manifestation_of")
VALIDATION_STATUSES = ("Correct", "Incorrect", "Uncertain")
MATCH_PREDICATES = {"Exact": "skos:exactMatch", "Broader": "skos:broadMatch", "Narrower": "skos:narrowMatch"}

# Limits and thresholds.
MAX_EVIDENCE_WORDS = 25
MAX_CATEGORIES = 20
ENTITY_SCORE_FLOOR = 0.1
THRESHOLD_SCORE = 0.15
THRESHOLD_DENSITY = 0.05
SIMILARITY = 0.85
SIMILARITY_COMMAND_LINE = 0.99
DESCENT_THRESHOLD = 0.90
CHILD_LIMIT = 50
PROMPT_MARGIN = 8
DEFAULT_LABELS = ("drug", "disease", "biomarker", "symptom")
CSV_ENCODINGS = ("utf-8-sig", "latin-1")
CSV_SEPARATORS = ",;\t|"
CSV_SAMPLE_CHARS = 64 * 1024

# Text repair.
MOJIBAKE_MARKERS = ("Ã", "Â", "â€")
ONE_BYTE_ENCODINGS = ("cp1252", "latin-1")
WHITE_SPACE = ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"))
LINE_BREAK_HYPHEN = "-\n[ ]*(?=[a-záéíóúüñ])"

# The code fence that a model may put around JSON.
CODE_FENCE = r"\A```(?:json)?\s*|\s*```\Z"

# Shapes of laboratory values.
LAB_VALUE = (r"[a-z]{2,10}-\p{Nd}+\.?\p{Nd}*", r"[a-z]{1,6}-[a-z]{1,6}-\p{Nd}+\.?\p{Nd}*")

# Turtle prefixes.
PROJECT_PREFIX = "http://example.org/ontology#"
TURTLE_HEADER = (
    f"@prefix proj: <{PROJECT_PREFIX}> .\n"
    "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
    "@prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n"
)

# Top-level concepts of the terminology (code, display).
TOP_LEVEL_CONCEPTS = (
    ("404684003", "Clinical finding"),
    ("71388000", "Procedure"),
    ("123037004", "Body structure"),
    ("373873003", "Pharmaceutical / biologic product"),
    ("105590001", "Substance"),
    ("243796009", "Situation with explicit context"),
    ("410607006", "Organism"),
    ("260787004", "Physical object"),
    ("363787002", "Observable entity"),
    ("123038009", "Specimen"),
    ("272379006", "Event"),
    ("272391002", "Physical force"),
    ("256235009", "Environment or geographical location"),
    ("410604004", "Social context"),
    ("900000000000441003", "SNOMED CT Model Component"),
    ("370115009", "Special concept"),
    ("254291000", "Staging and scales"),
    ("419891008", "Record artifact"),
    ("106237007", "Qualifier value"),
)

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself "
    "she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as "
    "until while of at by for with about against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain "
    "aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# The prompt for a batch of variables.
VARIABLES_PROMPT = """You are a medical ontology assistant tasked with organizing the {n} variables below.

For each variable, propose:
- a normalized concept,
- a semantic category (Symptom, Disease, Treatment, Biomarker, Assessment, Demographic, Lifestyle, etc.),
- one relevant relation, when appropriate.

Use only the information provided.
Return one simple result per variable.

Answer strictly as a JSON array, one object per variable, with the keys:
"variable", "normalized_concept", "semantic_category", "relation".

Variables:
{variables}
"""
VARIABLE_LINE = "- {name} | type: {type} | example: {example} | description: {description}"
VARIABLE_EVIDENCE = "type: {type} | example: {example} | description: {description}"

# Fields that a person fills in later, and what they hold until then.
MANUAL_FIELDS = {"source_ontology": "", "preferred_label": "", "identifier_uri": "", "match": "", "status": "", "validation_status": "Uncertain"}

# The ten declared variables (name, type, example, description).
DECLARED_VARIABLES = (
    ("RheumatoidArthritis", "binary numeric", "0 / 1", "Rheumatoid arthritis is a type of arthritis where your immune system attacks the tissue lining the joints on both sides of your body. It may affect other parts of your body, too. The exact cause is unknown. Treatment options include lifestyle changes, physical therapy, occupational therapy, nutritional therapy, medication and surgery."),
    ("BRI", "continuous numeric", "4.82", " body roundness index (BRI) – may be more effective at measuring a person’s health. Whereas BMI is determined using one’s height and weight only, BRI also includes an individual’s waist circumference (or roundness) in the calculation. The result is a clearer picture of how body fat is distributed: The more fat in the middle of your body, the more at-risk you are for some health conditions., unitless"),
    ("Age", "integer", "22", "age in years"),
    ("SmokingStatus", "categorical text", "Former", "a standard classification that describes a person's current and past habits regarding tobacco use"),
    ("BMI", "continuous numeric", "27.4", "Body mass index (BMI) is a tool that uses your height and weight to estimate your body fat. It can help identify your risk for certain health conditions, like heart disease. You can calculate your BMI using a simple math formula. BMI has limitations because it doesn’t consider all aspects of your health. in kg/m2"),
    ("DrinkingStatus", "ordinal categorical text", "Occasional drinker", "is a standardized clinical term used to document a patient's current and historical patterns of alcohol consumption."),
    ("Hypertension", "binary categorical text", "Normal", " Blood pressure is the force of blood pushing against the walls of your arteries as your heart pumps. HTN means this pressure is consistently too high."),
    ("Diabetes", "categorical text", "Prediabetes", "a chronic condition that causes your blood sugar (glucose) levels to become too high"),
    ("Hyperlipidemia", "binary categorical text", "Normal", "Hyperlipidemia (high cholesterol) means you have too many lipids (fats) in your blood, which increases your risk of heart attack and stroke."),
    ("PhysicalActivity", "ordinal categorical text", "Moderate activity", "any bodily movement produced by skeletal muscles that requires energy expenditure"),
)
