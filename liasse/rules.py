"""Word lists, patterns, weights and limits.

They must equal the values the results are compared with, so they are kept
together here as plain text. Patterns are written for text folded to lower
case without accents wherever the job folds it first (``né`` is ``ne``).
"""

# --- chunking and indexing (fixed values) ---
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
ANCHOR_CHARS = 2400
ANCHOR_PAGES = 2
DOC_TEXT_CHARS = 60_000
SECTION_CHARS = 12_000
EXCERPT_CHARS = 8_000
BLOCK_CHARS = 8_000
SEGMENT_CHARS = 12_000
BLOCKS_PER_GROUP = 5

# --- retrieval (fixed values) ---
BM25_K1, BM25_B, BM25_EPS = 1.5, 0.75, 0.25
RRF_K = 60
TOP_K, SEARCH_MULT, MAX_PER_SOURCE = 12, 6, 3
MMR_LAMBDA, MMR_LAMBDA_IDENTITY, MMR_LAMBDA_INVENTORY = 0.7, 0.78, 0.85
INVENTORY_TOPK, INVENTORY_L = 3, 2
BOOSTS = {"lexical": 1, "dense": 1, "name": 1, "phrase": 1, "identity": 2, "fact": 4}
IDENTITY_DOC_TYPES = ["pv_identite", "identite", "etat_civil", "etat civil", "signalement"]
IDENTITY_TITLES = ["identite", "etat civil", "signalement", "filiation"]
IDENTITY_SOURCES = ["identite", "etat_civil", "etat civil", "signalement"]
IDENTITY_TERMS = [
    "identite", "etat civil", "date de naissance", "naissance", "ne le", "nee le",
    "lieu de naissance", "nationalite", "domicile", "adresse", "reside", "filiation",
    "pere", "mere", "signalement", "taille", "poids", "cheveux", "yeux",
    "piece d identite", "carte nationale", "passeport", "cni", "nni",
]
IDENTITY_LABELS = ["nom :", "prenom :", "filiation :", "adresse :"]
INVENTORY_TERMS = [
    "liste", "lister", "recense", "recenser", "inventaire", "exhaustif", "exhaustive",
    "tous les", "toutes les", "l'ensemble", "la totalite", "global", "complet",
    "tous les pv", "toutes les pv", "tous les proces", "tous les actes",
    "toutes les auditions", "toutes les perquisitions",
]
HISTORY_TOKENS = 4096
ROLE_PREFIX = {"user": "Utilisateur : ", "assistant": "Assistant : ", "": "Système : "}
CONTEXT_CHUNKS_PER_UNIT = 6
CITE_PATTERN = r"(?i)\[source:\s*([^,\]]+)\s*,\s*chunk\s*(\d+)\s*\]"

# --- dates (fixed values) ---
MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7,
    "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
}
MONTH_DAYS = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
TIME_TRAIL = r"(?iU)\b(?:à|a)\s*\d{1,2}[:h]\d{2}(?::\d{2})?\b"
DATE_DMY = r"(?U)\b\d{1,2}[./\-]\d{1,2}[./\-]\d{4}\b"
DATE_YMD = r"(?U)\b\d{4}[\-/]\d{1,2}[\-/]\d{1,2}\b"
DATE_WORDS = r"(?iU)\b(?:le\s+)?(\d{1,2})\s+([a-zéèêëàâîïôöùûç]+)\s+(\d{4})\b"
DATE_COMPACT = r"(?U)\b\d{8}\b"
FILE_ISO = r"(\d{4})[\-_.](\d{2})[\-_.](\d{2})"
FILE_COMPACT = r"(?U)\b(\d{4})(\d{2})(\d{2})\b"
FILE_DMY = r"(?U)\b(\d{2})[\-_.](\d{2})[\-_.](\d{4})\b"

# --- document types: first group that matches wins (fixed values) ---
DOC_TYPES = [
    ("pv_audition", r"\bpv d['’]?\s*audition\b|\bpv\s+audition\b|\baudition\s+de\b"),
    ("pv_gav", r"\bgarde\s*à\s*vue\b|\bgav\b"),
    ("pv_identite",
     r"\bv[ée]rification\s+d['’]?\s*identit[ée]\b|\bcontr[ôo]le\s+d['’]?\s*identit[ée]\b"
     r"|\b[eé]tat\s+civil\b|\bsignalement\b|\bfiliation\b|\bpi[eè]ce\s+d['’]?\s*identit[ée]\b"
     r"|\bcarte\s+nationale\b|\bpasseport\b|\bidentit[ée]\b"),
    ("pv", r"\bproc[eè]s\-?verbal\b|\bpv\b"),
    ("rapport", r"\brapport\b|\brap\.\b"),
    ("expertise", r"\bexpertise\b|\bexpert\b"),
    ("ecoutes", r"\b[eé]coutes?\b|\binterceptions?\b|\btranscriptions?\b"),
    ("constatations", r"\bconstat(?:ation|ations)?\b|\bproc[eè]s\-?verbal\s+de\s+constat\b"),
]
# words of which any text that one of these patterns finds has one
DOC_TYPE_CUES = {
    "pv_audition": ["audition"], "pv_gav": ["vue", "gav"],
    "pv_identite": ["identit", "civil", "signalement", "filiation", "nationale", "passeport"],
    "pv": ["verbal", "pv"], "rapport": ["rap"], "expertise": ["expert"],
    "ecoutes": ["coute", "interception", "transcription"], "constatations": ["constat"],
}
DOC_TYPE_LABELS = {
    "pv_audition": "PV d’audition", "pv_gav": "PV de GAV", "pv": "Procès-verbal",
    "rapport": "Rapport", "expertise": "Expertise", "ecoutes": "Transcription/Écoutes",
    "constatations": "Constatations",
}
TITLE_MOTIFS = (
    r"(?iU)\bproc[èe]s[- ]?verbal\b|\bpv d['’]?\s*audition\b|\bpv\s+audition\b|\baudition\s+de\b"
    r"|\bgarde\s*à\s*vue\b|\bgav\b|\bv[ée]rification\s+d['’]?\s*identit[ée]\b"
    r"|\bcontr[ôo]le\s+d['’]?\s*identit[ée]\b|\b[eé]tat\s+civil\b|\bsignalement\b|\bfiliation\b"
    r"|\brapport\b|\bexpertise\b|\bconstat(?:ation|ations)?\b"
)
# words of which any title motif has one
TITLE_CUES = "verbal|audition|vue|gav|identite|civil|signalement|filiation|rapport|expertise|constat"
# on lower-case text without accents
FORM_FIELDS = [
    r"(?U)\bnom\s*[:\-]", r"(?U)\bprenom\s*[:\-]", r"(?U)\bdate\s+et\s+lieu\s+de\s+naissance\s*[:\-]",
    r"(?U)\bdate\s+de\s+naissance\s*[:\-]", r"(?U)\blieu\s+de\s+naissance\s*[:\-]",
    r"(?U)\bfiliation\s*[:\-]", r"(?U)\badresse\s*[:\-]", r"(?U)\bdomicile\s*[:\-]",
    r"(?U)\bn0m\s*[:\-]", r"(?U)\bpren0m\s*[:\-]",
]
# a word that any hit of each of them has
FORM_CUES = ["nom", "prenom", "naissance", "naissance", "naissance", "filiation", "adresse", "domicile", "n0m", "pren0m"]
FORM_FILIATION = r"(?U)\bfiliation\s*[:\-]"
FORM_TITLE = "IDENTITÉ / ÉTAT CIVIL (détecté)"
UNIT_TYPES = [
    ("pv_audition", ["audition", "entretien"]),
    ("pv_perquisition", ["perquisition", "visite domiciliaire"]),
    ("pv_gav", ["garde à vue", "garde a vue", "gav"]),
    ("requisition", ["réquisition", "requisition"]),
    ("rapport", ["rapport", "synthèse", "synthese"]),
]

# --- identity facts: label words by field, folded (fixed values) ---
FACT_LABELS = {
    "nom": ["nom", "nom de famille"],
    "prenom": ["prenom", "prenoms", "prenom(s)"],
    "naissance": ["date et lieu de naissance", "date de naissance", "lieu de naissance",
                  "naissance", "ne le", "nee le"],
    "filiation": ["filiation", "parents", "pere", "mere"],
    "adresse": ["adresse", "domicile", "residence", "demeurant", "residant", "domicilie",
                "domiciliee", "habite", "demeure"],
    "situation_familiale": ["situation familiale", "etat matrimonial", "marie", "mariee",
                            "celibataire", "divorce", "divorcee", "pacse", "pacsee", "veuf",
                            "veuve", "enfants", "conjoint"],
    "profession": ["profession", "emploi", "activite", "occupation"],
    "nationalite": ["nationalite", "nation"],
}
FACT_PRINT = [
    ("nom", "NOM"), ("prenom", "PRÉNOM"), ("naissance", "NAISSANCE"),
    ("nationalite", "NATIONALITÉ"), ("profession", "PROFESSION"),
    ("situation_familiale", "SITUATION FAMILIALE"), ("filiation", "FILIATION"),
    ("adresse", "ADRESSE"),
]
FACT_PREFIX = "IDENTITÉ (extrait structuré) — "
FACT_TITLES = ["identité", "identite", "etat civil", "état civil", "signalement", "filiation"]
FACT_NARRATIVE = {
    "adresse": r"\b(?:demeurant|residant|domicilie\s+a|habite|demeure)\b\s*(.+?)"
               r"(?=\b(?:ne|nee)\b|\bfiliation\b|\bnationalit|\bprofession\b|\bsituation familiale\b|$)",
    "naissance": r"\b(?:ne|nee)\s+le\s+(.+?)"
                 r"(?=\bfiliation\b|\badresse\b|\bdemeurant\b|\bnationalit|\bprofession\b|\bsituation familiale\b|$)",
    "nationalite": r"\bnationalite\s*[:\-]?\s*(.+?)"
                   r"(?=\bprofession\b|\bsituation familiale\b|\bfiliation\b|\badresse\b|$)",
    "profession": r"\b(?:profession|emploi|occupation|activite)\b\s*[:\-]?\s*(.+?)"
                  r"(?=\bsituation familiale\b|\bfiliation\b|\badresse\b|$)",
    "situation_familiale": r"\b(?:situation familiale|etat matrimonial)\b\s*[:\-]?\s*(.+?)"
                           r"(?=\bfiliation\b|\badresse\b|\bprofession\b|$)",
}

# words without one of which the narrative rule cannot match
FACT_NARRATIVE_CUES = {
    "adresse": ["demeur", "resida", "domicilie", "habite"], "naissance": ["ne ", "nee "], "nationalite": ["nationalite"],
    "profession": ["profession", "emploi", "occupation", "activite"], "situation_familiale": ["familiale", "matrimonial"],
}
# the cue of "naissance" on text whose white space isn't collapsed
FACT_BORN_CUE = r"nee?[\t-\r\x1c-\x20]+le"

# --- entities (fixed values) ---
PHONE = (
    r"(?U)(?:(?<=\s)|(?<=^)|(?<=\())"
    r"(?:(?:\+|00)\s?33\s*(?:\(0\))?\s*[1-9](?:[.\-\s]*\d{2}){4}|0[1-9](?:[.\-\s]*\d{2}){4})(?=\D|$)"
)
IBAN = r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
EMAIL = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
IPV4 = r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
PLATE = r"(?U)(?:\b[A-Z]{2}-\d{3}-[A-Z]{2}\b|\b\d{1,4}\s?[A-Z]{1,3}\s?\d{2,3}\b)"
TELEGRAM_HANDLE = r"@([A-Za-z0-9_]{3,32})"
TELEGRAM_LINK = r"(?i)(?:t\.me|telegram\.me)/([A-Za-z0-9_]{3,32})"
WHATSAPP_LINK = r"(?i)(?:wa\.me|api\.whatsapp\.com)/(?:message/)?([A-Za-z0-9]+)"
SNAPCHAT_LINK = r"(?i)(?:snapchat\.com/add/|snapchat\.com/t/)([A-Za-z0-9.\-_]{3,32})"
SNAPCHAT_USER = r"(?U)\b([A-Za-z0-9.\-_]{3,15})\b"
PERSON_WINDOW = 80
THEMES = {
    "phones": "phone", "iban": "iban", "emails": "email", "plates": "plate", "plaques": "plate",
    "ips": "ip", "telegram": "telegram", "whatsapp": "whatsapp", "snapchat": "snapchat",
}
THEME_LABELS = {
    "phones": "Téléphones", "iban": "IBAN / comptes bancaires", "emails": "Adresses e-mail",
    "plates": "Plaques d'immatriculation / véhicules", "ips": "Adresses IP",
    "telegram": "Comptes / pseudos Telegram", "whatsapp": "Comptes / numéros WhatsApp",
    "snapchat": "Comptes / pseudos Snapchat",
}

# --- phone roles; {P} stands for the person's names (fixed values) ---
USED_STRONG, USED_MEDIUM, CONTACT, WEAK = 0.8, 0.6, 0.6, 0.35
UNLINKED_FACTOR, CONFIDENCE_MIN, CONFIDENCE_MAX = 0.5, 0.30, 0.95
USED_STRONG_PATTERNS = [
    r"\bnumero(?: de(?: telephone| tel)?)?\s+de\s+{P}\b",
    r"\bligne\s+(?:de|au nom de)\s+{P}\b",
    r"\babonnement\s+(?:de|au nom de)\s+{P}\b",
    r"\battribuee?\s+a\s+{P}\b",
    r"\btitulaire\s*:?\s+{P}\b",
]
USED_MEDIUM_PATTERNS = [
    r"\b{P}\s+(?:utilise|utilisait|joignable au|contactable au)\b",
    r"\bau nom de\s+{P}\b",
    r"\bmsisdn\b.*\b{P}\b",
    r"\bimei\b.*\b{P}\b",
    r"\bimsi\b.*\b{P}\b",
]
CONTACT_PATTERNS = [
    r"\bappele(?:e)?\s+par\s+{P}\b",
    r"\bcontact\s+(?:de|avec)\s+{P}\b",
    r"\bcorrespondant\s+de\s+{P}\b",
    r"\bcommunication\s+avec\s+{P}\b",
    r"\bconversation\s+avec\s+{P}\b",
]
WEAK_CONTEXT = r"\bappels?\b|\bappelant\b|\bappele\b|\bcontact\b|\bconversation\b"

# --- person snippets, on folded text (fixed values) ---
CIVIL = [
    r"(?iU)nee?\s+le\s+\d{1,2}", r"(?iU)nee\s+le\s+\d{1,2}", r"(?iU)ne\s+le\s+\d{1,2}",
    r"(?iU)domiciliee?\s+(?:au|a)\s", r"(?iU)demeurant\s+(?:au|a)\s", r"(?iU)residant\s+(?:au|a)\s",
    r"(?iU)de nationalite", r"(?iU)de profession", r"(?iU)celibataire|mariee?|divorcee?|veuf|veuve",
    r"(?iU)fils de|fille de",
]
# of each of these patterns, strings of which any hit in folded text has one; none with an i, for which other letters may stand
CIVIL_CUES = [["ne le ", "nee le "], ["nee le "], ["ne le "], ["dom"], ["demeurant "], ["dant "], ["de nat"], ["de profess"], ["bata", "mar", "vorce", "veu"], ["ls de", "lle de"]]
ADDRESS = [
    r"(?iU)domiciliee?\s+(?:au|a|chez)\s", r"(?iU)demeurant\s+(?:au|a|chez)\s",
    r"(?iU)residant\s+(?:au|a|chez)\s", r"(?iU)adresse\s+(?:principale|actuelle|au)\s",
]
ADDRESS_CUES = [["dom"], ["demeurant "], ["dant "], ["adresse "]]
BIRTH_WORDS = r"ne le|nee le|ne\(e\) le"
AUDITION = ["premiere audition", "1ere audition", "grande identite",
            "interrogatoire de premiere comparution", "ipc"]
PROCEDURAL = [
    r"(?iU)requisition", r"(?iU)extraction telephonique", r"(?iU)exploitation du telephone",
    r"(?iU)perquisition", r"(?iU)commission rogatoire", r"(?iU)ecoutes telephoniques?",
    r"(?iU)exploitation de scelle", r"(?iU)facturation detaillee",
]
PROCEDURAL_CUES = [["requ"], ["extract"], ["explo"], ["perqu"], ["rogato"], ["ecoutes t"], ["scelle"], ["factur"]]
CIVIL_QUERY = ("{} première audition identité né le demeurant interrogatoire de première "
               "comparution IPC grande identité")
GLOBAL_QUERY = ("{} audition perquisition réquisition téléphonique facturation détaillée comptes "
                "bancaires mouvements financiers écoutes téléphoniques adresses IP réquisitions bancaires")
ADDRESS_QUERY = ("{} domicilié demeurant résidant adresse principale adresse actuelle demeurant à "
                 "résidant à domicilié à")

# --- evidence categories by family, on folded text (fixed values) ---
EVIDENCE = {
    "procedure": {
        "gav": ["garde a vue", "gav", "retenu", "retenue", "debut de garde a vue",
                "fin de garde a vue"],
        "crt": ["commission rogatoire", "crt", "rogatoire technique"],
        "ecoutes": ["ecoute", "interception", "captation", "enregistrement", "retranscription"],
        "geoloc": ["borne", "bornage", "geolocal", "cell-id", "cell id", "localisation antenne",
                   "cdr", "fadet"],
        "balise": ["balise", "tracker", "geotrace", "dispositif de suivi", "pose de balise",
                   "geotracking"],
        "sono": ["sonorisation", "captation sonore", "pose de micro", "vehicule sonorise",
                 "piece sonorisee"],
    },
    "science": {
        "adn": ["adn", "profil genetique", "analyse genetique", "locus"],
        "empreintes": ["empreinte", "papillaire", "dactylo", "trace papillaire"],
        "balistique": ["balistique", "projectile", "douille", "etude balistique"],
        "forensic_phone": ["extraction", "ufed", "cellebrite", "dump", "physical extraction",
                           "logical extraction", "analyse telephone", "analyse mobile"],
        "odorologie": ["odorologie", "piste olfactive"],
    },
    "statements": {
        "audition": ["audition de", "proces-verbal d audition", "declare que", "declarant que",
                     "interrogatoire", "ipc", "deposition", "entendu", "entendue"],
    },
}
STATEMENT_DOC_TYPES = ["pv_audition", "pv_gav"]

# --- charge / discharge buckets, on folded text (fixed values) ---
BUCKETS = [
    ("empreintes_papillaires", "Empreintes papillaires",
     r"\bempreinte(?:s)? (?:relevee|relevees|trouvee|trouvees)\b|\bcorrespondance d'?empreinte\b",
     r"\baucune empreinte\b|\bempreinte (?:non|pas) exploitable\b|\bempreinte d'?un tiers\b"),
    ("adn", "Empreintes génétiques (ADN)",
     r"\badn (?:releve|relevee|trouve|trouvee)\b|\bprofil genetique (?:concordant|associe)\b",
     r"\baucun adn\b|\badn d'?un tiers\b|\badn non (?:concordant|correspondant)\b"),
    ("temoignages", "Témoignages",
     r"\btemoin (?:indique|decrit|reconnait)\b|\bidentifie (?:formellement|clairement)\b",
     r"\btemoignage (?:contredit|imprecis|incertain)\b|\balibi (?:rapporte|corrobore)\b"),
    ("videos", "Vidéosurveillance / Caméras",
     r"\b(?:cctv|videosurveillance|camera)\b.*\bmontre\b|\bvu sur (?:cctv|video)\b",
     r"\baucune image exploitable\b|\bimage floue|non identifiable\b"),
    ("alibi", "Alibi",
     r"\balibi (?:non (?:verifie|corrobore|credible)|contredit)\b",
     r"\balibi (?:verifie|corrobore|coherent)\b|\bvu ailleurs\b"),
    ("geoloc_tel", "Géolocalisation téléphonique",
     r"\bbornage\b.*\bconcordant\b|\bantenne\b.*\bpresence\b|\bgeolocalis(?:e|ation)\b.*\bsite\b",
     r"\bbornage\b.*\bnon (?:concordant|probant)\b|\bmultiples cellules\b"),
    ("transactions_bancaires", "Transactions bancaires",
     r"\bvirement\b|\btransfert\b|\bretrait\b|\bpaiement\b",
     r"\baucun mouvement\b|\bcompte d'?un tiers\b"),
    ("plaques", "Plaques / Véh.",
     r"\bplaque\b.*\bassociee\b|\bvehicule\b.*\butilise par\b|\bvu conduisant\b",
     r"\bvehicule d'?un tiers\b|\bnon (?:titulaire|proprietaire)\b"),
    ("ips", "Connexions IP",
     r"\badresse ip\b.*\bconnexion\b|\blog\b.*\bdepuis\b",
     r"\bip partagee\b|\breseau public\b|\bfree wifi\b"),
]
PHONE_USE = r"\bappel (?:emis|recu)\b|\bconversation|ecoute\b|\butilise par|attribue a|titulaire\b"
PHONE_MIN_LINKED = 2
PROCEDURE_HINTS = [
    "audition", "perquisition", "commission rogatoire", "garde a vue", "ordonnance",
    "requisitoire", "jugement", "expertise", "pv d'audition", "requisitions", "decision",
    "commission", "proces-verbal", "opj", "brigade", "parquet", "instruction",
]
FACT_DATE_SLASH = r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b"
FACT_DATE_ISO = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
FACT_DATE_WORDS = r"(?iU)\b\d{1,2}\s+[A-Za-zéûîôàäëïöüç]+\s+\d{4}\b"
FACT_TIME_H = r"(?U)\b\d{1,2}h\d{0,2}\b"
FACT_TIME_COLON = r"(?U)\b\d{1,2}:\d{2}\b"

# --- sentence analysis (fixed values) ---
SENTENCE_CHARGE = ["reconnu", "aveu", "fraude", "compromettant", "trace", "localisation", "appel",
                   "virement", "preuve", "impliqué", "implication", "en relation", "utilisé",
                   "titulaire", "au nom de", "contacté", "correspondant"]
SENTENCE_DISCHARGE = ["alibi", "démenti", "erreur", "absence", "aucun lien", "non impliqué",
                      "décorrélé", "confusion", "homonyme", "autorisé", "légal"]
SENTENCE_DATES = [
    r"(?iU)\b(\d{1,2}\s+(?:janv(?:ier)?|févr(?:ier)?|mars|avril|mai|juin|juil(?:let)?|août"
    r"|sept(?:embre)?|oct(?:obre)?|nov(?:embre)?|déc(?:embre)?)\s+\d{4})\b",
    r"(?U)\b(\d{4}-\d{2}-\d{2})\b",
    r"(?U)\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})\b",
]
BIRTH_DATE = (r"(?iU)n[ée]e?\s+le\s+([0-3]?\d(?:[/.\-][0-1]?\d[/.\-]\d{2,4}"
              r"|\s+[a-zéèêàâôîûùç]+\s+\d{2,4}))")
BIRTH_PLACE = r"(?iU)n[ée]e?\s+le\s+.+?\s+[àa]\s+([a-zéèêàâîôûùç][^,\n;]+)"
ADDRESS_LINE = r"(?iU)(?:domicili[ée]e?|demeurant|r[ée]sidant)\s+(?:au|[àa]|chez)\s+[^.;]+"
