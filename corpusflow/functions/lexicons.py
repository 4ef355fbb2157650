"""Default word lists and patterns.

Fixed values: everything in this module has to equal the values users of the
original rules rely on. All of it can be replaced through parameters.
"""

# --- cleaning policy -------------------------------------------------------
GENERALIST_WORDS = [
    "salut", "ca va", "ça va", "blague", "humour", "roleplay", "jeu de role",
    "opinion perso", "vie quotidienne", "emotion", "émotion",
]
OFF_DOMAIN_WORDS = [
    "politique", "religion", "psychologie", "sante", "santé", "relation amoureuse",
    "astrologie", "sport", "people", "divertissement",
]
TOXIC_WORDS = [
    "insulte", "haine", "raciste", "sexiste", "violent", "violence", "agression",
]
NEGATION_HINTS = ["sans", "eviter", "éviter", "interdit", "refuser", "ne pas", "pas de"]
SMS_PATTERNS = [r"\bmdr\b", r"\blol\b", r"\bpk\b", r"\bstp\b", r"\bsvp\b", r"\bjtm\b"]
NOISE_PATTERNS = [
    r"\bslt\b", r"\bbjr\b", r"\bcv\b", r"\bpkoi\b", r"\btt\b", r"\bdsl\b", r"\btkt\b",
    r"(.)\1{4,}", r"[!?]{3,}",
]
SHORT_WORDS_ALLOWED = ["ia", "ml", "ai", "de", "du", "la", "le", "et"]
SUBJECTIVE_PATTERNS = [
    r"\bje pense que\b", r"\ba mon avis\b", r"\bà mon avis\b", r"\bje ressens\b",
    r"\bc[' ]est triste\b", r"\bc[' ]est joyeux\b", r"\bc[' ]est frustrant\b",
]
HESITATION_PATTERNS = [
    r"\bje ne suis pas sur\b", r"\bje ne suis pas sûr\b", r"\bpeut[- ]etre\b",
    r"\bpeut[- ]être\b", r"\bje crois que\b", r"\bpas certain\b",
]
LIMITATION_PATTERNS = [
    r"\bje ne peux pas\b", r"\bje ne peux rien executer\b", r"\bje ne peux rien exécuter\b",
    r"\bje ne peux pas executer\b", r"\bje ne peux pas exécuter\b",
    r"\bje ne peux pas envoyer\b", r"\bje ne peux pas automatiser\b",
]
APOLOGY_PATTERNS = [
    r"\bdesole\b", r"\bdésolé\b", r"\bpardon\b", r"\bje suis vraiment desole\b",
    r"\bje suis vraiment désolé\b",
]
STYLE_PATTERNS = [
    r"\bfranchement\b", r"\bcarr[ée]ment\b", r"\bgrave\b", r"\btruc\b", r"\bgenre\b",
    r"\bkif\b", r"\bcool\b", r"\bsympa\b",
]
OUTDATED_PATTERNS = [
    r"\bpython\s*2\b", r"\btensorflow\s*1\b", r"\bsklearn\.cross_validation\b",
    r"\bimp\s+module\b", r"\bfrom\s+__future__\s+import\s+print_function\b",
]
INVENTION_PATTERNS = [
    r"\bapi\s+magique\b", r"\boutil\s+secret\b", r"\bendpoint\s+fictif\b",
    r"\bworkflow\s+impossible\b", r"\b100%\s+garanti\b", r"\bnavigation\s+privee\b",
    r"\bnavigation\s+privée\b", r"\bextensions?\b", r"\bmot\s+de\s+passe\s+oublie\b",
    r"\bmot\s+de\s+passe\s+oubli[eé]\b",
    r"\bsuivez\s+les\s+instructions\s+recues\s+par\s+email\b",
    r"\bsuivez\s+les\s+instructions\s+re[cç]ues\s+par\s+email\b",
    r"\bverification\s+rapide\b", r"\bv[eé]rification\s+rapide\b", r"\bmode\s+incognito\b",
    r"\bcompte\s+(bloque|bloqu[eé])\b",
]
LOW_SIGNAL_ANSWERS = ["bien sur", "bien sûr", "voici", "ok", "d'accord", "daccord", "oui", "non"]
LOW_SIGNAL_STRIP = " .,!?:;\"'"
DOMAIN_FILTER_WORDS = [
    "ia", "ml", "machine learning", "python", "sql", "api", "workflow", "automatisation",
    "pipeline", "dataset", "debug", "classification", "planification",
]

# --- conversation store ----------------------------------------------------
STORE_DOMAIN_WORDS = [
    "ia", "ml", "ai", "machine learning", "python", "sql", "api", "workflow",
    "automatisation", "pipeline", "dataset", "classification", "regression", "debug",
    "lora", "n8n",
]
STORE_OFF_DOMAIN_WORDS = [
    "politique", "religion", "psychologie", "sante", "santé", "sport", "divertissement",
    "actualite", "actualité", "relation",
]
STORE_TOXIC_PATTERNS = [
    r"\bidiot\b", r"\bcon\b", r"\bfdp\b", r"\bmerde\b", r"\bferme ta gueule\b",
]
STORE_EMOTIONAL_PATTERNS = [
    r"\bje me sens\b", r"\bje suis triste\b", r"\bje suis deprime\b",
    r"\bje suis déprimé\b", r"\bje t'aime\b", r"\bje t aime\b",
]
STORE_HESITATION_PATTERNS = [
    r"\bje ne suis pas sur\b", r"\bje ne suis pas sûr\b", r"\bpeut[- ]etre\b",
    r"\bpeut[- ]être\b", r"\bje crois que\b",
]
STORE_LIMITATION_PATTERNS = [
    r"\bje ne peux pas\b", r"\bje ne peux rien executer\b", r"\bje ne peux rien exécuter\b",
    r"\bje ne peux pas envoyer\b", r"\bje ne peux pas automatiser\b",
]
ERROR_WORDS = ["traceback", "exception", "error"]
TAG_WORDS = ["ia", "ml", "python", "sql", "api", "workflow", "automatisation", "debug", "dataset"]
PAIR_INTENTS = [
    ("summary", ["resume", "résume", "summary"]),
    ("workflow", ["workflow", "json", "action"]),
    ("code_help", ["erreur", "debug", "traceback"]),
    ("planification", ["plan", "etape", "étape"]),
]

# --- answer verification ---------------------------------------------------
TECH_MARKERS = [
    "data", "dataset", "csv", "json", "sql", "pandas", "numpy", "pipeline", "api", "fastapi",
    "python", "modele", "model", "entrainement", "evaluation", "automatisation", "workflow",
]
OUT_DOMAIN_MARKERS = [
    "politique", "election", "religion", "medecine", "medical", "diagnostic", "amour",
    "relation", "astrologie", "voyance",
]
BAD_PHRASES = [
    "je ne peux pas te dire que tu veux dire", "je veux dire que je n'ai pas besoin",
    "reheatreheatreheat", "synchronoussynchronous", "municipal municipal",
]
UNSTABLE_PATTERN = r"\b(de\s+te\s+dire\s+que\s+tu|vous\s+avez\s+une\s+idee\s+de)\b"
CHAT_BAD_PHRASES = [
    "je ne peux pas te dire que tu veux dire", "je veux dire que je n'ai pas besoin",
    "je ne sais pas. je veux dire", "je n'ai pas l'air", "je veux dire que",
]
EMPTY_ANSWERS = ["je ne sais pas.", "je sais pas.", "ok.", "d'accord."]

# --- domain and intent -----------------------------------------------------
CHAT_DOMAIN_WORDS = [
    "data", "donnee", "donnees", "dataset", "csv", "json", "excel", "table", "sql",
    "pandas", "numpy", "analyse", "nettoyage", "feature", "visualisation", "statistique",
    "ml", "ia", "ai", "machine learning", "modele", "model", "entrainement", "evaluation",
    "classification", "regression", "prediction", "prompt", "llm", "token", "embedding",
    "pipeline", "workflow", "automatisation", "script", "python", "fastapi", "api", "docker",
]
SPACE_DOMAIN_WORDS = CHAT_DOMAIN_WORDS + [
    "overfitting", "surapprentissage", "underfitting", "sous apprentissage", "biais variance",
    "precision", "recall", "f1", "matrice de confusion", "cross validation",
    "validation croisee", "k fold", "feature engineering", "data leakage", "fuite de donnees",
    "regularisation", "learning rate", "gradient descent", "desequilibre", "class imbalance",
    "one hot", "normalisation", "standardisation", "feature selection", "hyperparametre",
    "tuning", "baseline", "mae", "rmse", "r2", "roc", "auc", "pr auc", "data drift",
    "concept drift", "drift", "derive des donnees", "derive de concept", "seuil de decision",
    "threshold", "xgboost", "random forest",
]
CHAT_OUT_DOMAIN_WORDS = [
    "medecine", "medical", "maladie", "diagnostic", "traitement", "politique", "election",
    "religion", "psychologie", "depression", "amour", "relation", "sexe", "voyance",
    "astrologie", "finance personnelle", "pari", "bet", "casino", "juridique", "avocat",
]
OPENERS = ["bonjour", "salut", "hello", "bonsoir", "coucou", "bjr", "slt", "cc", "merci"]
QUESTION_MARKERS = [
    "cest quoi", "ca veut dire quoi", "definition", "definir", "explique", "expliquer",
    "difference", "pourquoi", "comment", "quand", "a quoi sert", "role",
]
FOLLOWUP_MARKERS = [
    "plus de details", "plus de detail", "detaille", "detailler", "approfondis", "approfondir",
    "des remarques", "remarques", "ton avis", "en pratique", "donne un exemple",
    "explique mieux", "ok et", "et du coup", "et ensuite", "pour aller plus loin",
]
AFFIRMATIONS = [
    "oui", "ouais", "yes", "ok", "okay", "daccord", "d accord", "vas y", "go", "parfait",
]
AFFIRMATION_TOKENS = [
    "oui", "ouais", "yes", "ok", "okay", "daccord", "d", "accord", "vas", "y", "go",
    "parfait", "fait", "fais", "le", "continuer", "continue",
]
AFFIRMATION_CONNECTORS = ["stp", "svp", "please", "alors", "du", "coup", "maintenant"]
INTENT_AUTOMATION = [
    "workflow", "automatisation", "automatiser", "api", "webhook", "n8n", "zapier",
    "plan d action", "orchestration", "pipeline", "executer", "exécuter",
]
INTENT_CODE = [
    "code", "python", "sql", "pandas", "script", "fonction", "debug", "erreur", "bug",
]
INTENT_TECH = [
    "data", "donnee", "dataset", "ml", "machine learning", "modele", "modèle", "ia",
    "analyse", "fastapi", "docker",
]
INTENT_OUT_DOMAIN = [
    "politique", "élection", "election", "médical", "medical", "diagnostic", "psychologie",
    "amour", "relation", "astrologie",
]
INTENT_PLAN_WORDS = ["plan", "étape", "etape", "execute", "exécute"]
GREETINGS = ["bonjour", "salut", "hello", "bonsoir", "coucou", "bjr", "slt", "cc"]
THANKS = ["merci", "thanks", "thx"]

# --- routing ---------------------------------------------------------------
SKILL_WORDS = [
    ("analyse_dataset", ["dataset", "csv", "nettoyage"]),
    ("debug_code", ["code", "python", "bug", "erreur"]),
    ("pipeline_ml", ["pipeline ml", "model", "modele", "entrainement"]),
    ("workflow_automation", ["workflow", "automatisation", "n8n", "api"]),
]
PERSONA_WORDS = [
    ("debugging", ["debug", "erreur", "stacktrace", "exception"], "debug_code"),
    ("data_analyst", ["dataset", "csv", "sql", "analyse"], "analyse_dataset"),
    ("automation", ["workflow", "automatisation", "n8n", "orchestration"], "workflow_automation"),
    ("documentation", ["doc", "documentation", "readme", "spec"], None),
]
TONE_WORDS = [
    ("pedagogique", ["explique", "debutant", "simple"]),
    ("detaille", ["detail", "complet"]),
    ("concis", ["rapid", "court", "resume"]),
]
EXPERT_INTENTS = ["automation_request", "code_request", "technical_question"]
TOPIC_WORDS = [
    ("api_integration", ["api", "webhook", "endpoint"]),
    ("data_analysis", ["dataset", "csv", "sql", "analyse"]),
    ("automation", ["workflow", "automatisation"]),
]
TOOL_RULES = [
    ("memory_summary", ["resume", "résumé", "synthese", "synthèse"], "summarization keywords"),
    ("integrations",
     ["api", "github", "jira", "notion", "slack", "discord", "trello", "drive"],
     "external tool keywords"),
    ("metacognition", ["expliquer", "pourquoi", "justifie", "justifier"], "explanation requested"),
    ("task_memory", ["tache", "tâche", "etape", "étape", "avancement"], "task tracking context"),
]
TOOL_LABELS = [
    ("github", ["github"]), ("notion", ["notion"]), ("messaging_webhook", ["slack", "discord"]),
    ("google_drive", ["drive"]), ("project_management", ["jira", "trello"]),
]
INTEGRATION_ITEMS = [
    ("github", "create_issue"), ("slack", "send_message"), ("discord", "send_message"),
    ("jira", "create_issue"), ("trello", "create_card"), ("notion", "create_page"),
    ("drive", "create_text_file"),
]
COMPLIANCE_WORDS = ["politique", "diagnostic", "astrologie", "religion"]
UNCERTAIN_WORDS = ["je pense peut-etre", "inconnu", "??"]
BLOCKED_ANSWER = (
    "Je reste sur data, IA et automatisation. Precise ton objectif technique, "
    "les entrees et le resultat attendu."
)
CLARIFY_WORDS = ["python", "api", "dataset", "sql", "pipeline"]
PLAN_ACTIONS = ["call_api_get", "transform_extract", "store_jsonl", "respond"]

# --- profile slots ---------------------------------------------------------
NAME_CHARS = r"([A-Za-zÀ-ÖØ-öø-ÿ\-']+)"
SLOT_PATTERNS = {
    "prenom": [r"(?:je m'appelle|mon prenom est|mon prénom est|je suis)\s+" + NAME_CHARS],
    "ville": [
        r"(?:je viens de|j'habite a|j'habite à|je vis(?: actuellement)? a"
        r"|je vis(?: actuellement)? à|ma ville est)\s+" + NAME_CHARS
    ],
    "sport": [
        r"(?:j'aime le|j'aime la|j'adore le|j'adore la|mon sport prefere est le"
        r"|mon sport prefere est la|mon sport prefere c'est le|mon sport prefere c'est la"
        r"|mon sport préféré est le|mon sport préféré est la|mon sport préféré c'est le"
        r"|mon sport préféré c'est la)\s+" + NAME_CHARS,
        r"(?:mon sport prefere|mon sport préféré)\s*[,;:\-]?\s*(?:est|c'est)?\s*(?:le|la)?\s*"
        + NAME_CHARS,
    ],
    "objectif_minutes": [
        r"(?:objectif|courir|course|entrainement|entraînement|seance|séance)?.{0,20}?"
        r"(\d+)\s*minutes"
    ],
}
SPORT_QUESTION = r"\bquel(?:le)?\s+sport\b"
SUMMARY_TECH = r"\b(pipeline|api|python|sql|pandas|workflow|dataset|modele|automatisation)\b"
SUMMARY_INTENT = r"\b(je veux|objectif|besoin|aide|corrige|explique)\b"
SUMMARY_COMMITMENT = r"\b(plan|etape|solution|je peux|voici|utilise|pipeline)\b"

# --- placeholders in texts to translate ------------------------------------
PLACEHOLDER_PATTERNS = [
    r"\bORD-\d+\b", r"\bINV-\d+\b", r"\bITM-\d+\b", r"\bE\d{3,5}\b",
    r"\b\d{1,2}:\d{2}\b", r"\b\d{3,5}\s?EUR\b",
]

# --- evaluation ------------------------------------------------------------
BAD_MARKERS = [
    "navigation privee", "extension", "mot de passe", "incognito", "compte bloque",
    "sur le sport", "journal de recherche", "je ne sais pas",
]
POSITIVE_HINTS = [
    "question", "explication", "demande", "pourquoi", "comment", "voici", "reponse", "etape",
]
FORBIDDEN_SOURCES = ["cornell_movie_dialogs", "dialog_csv", "movie"]
FORBIDDEN_PATHS = ["chatbot_train_fr.csv", "chatbot_pairs_fr.csv", "chatbot_pairs_en.csv"]
