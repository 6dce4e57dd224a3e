"""Fixed values of the search engines: word lists, weights, thresholds and patterns that results
depend on."""

# German stop words.
STOPWORDS = (
    "der", "die", "das", "ein", "eine", "einer", "einem", "einen", "und", "oder",
    "aber", "mit", "ohne", "auf", "in", "im", "am", "an", "zu", "zum", "zur",
    "von", "für", "ist", "sind", "war", "wie", "was", "wer", "wo", "wann",
    "warum", "welche", "welcher", "welches", "ich", "du", "er", "sie", "es",
    "wir", "ihr", "nicht", "kein", "keine", "mehr", "auch", "den", "dem",
    "des", "bei", "über", "unter", "nach",
)

# Programme and module synonyms of the configured engine, in order.
PROGRAM_SYNONYMS = {
    "informatik": ["in", "ai", "csc", "computer science", "kuenstliche intelligenz", "ki"],
    "computer science": ["informatik", "in", "csc", "ai", "ki"],
    "ki": ["kuenstliche intelligenz", "ai", "informatik", "in"],
    "kuenstliche intelligenz": ["ki", "ai", "informatik", "in"],
    "ai": ["ki", "kuenstliche intelligenz", "informatik", "in", "csc"],
    "csc": ["informatik", "in", "computer science", "ai", "ki"],
    "elektrotechnik": ["et", "e technik", "etechnik", "electronics"],
    "e technik": ["et", "elektrotechnik", "etechnik"],
    "et": ["elektrotechnik", "e technik", "etechnik"],
    "maschinenbau": ["mb", "mechanical engineering"],
    "mb": ["maschinenbau", "mechanical engineering"],
    "wirtschaftsinformatik": ["winf", "business informatics"],
    "winf": ["wirtschaftsinformatik", "business informatics"],
    "data science": ["ds"],
    "ds": ["data science"],
}
MODULE_SYNONYMS = {
    "theoretische informatik": ["tib", "theo", "thi"],
    "theoretische info": ["tib", "theo", "thi"],
    "theo": ["theoretische informatik", "tib"],
    "mathematik": ["mathe", "ma"],
    "mathematik 1": ["mathe 1", "ma1", "ma 1"],
    "mathematik 2": ["mathe 2", "ma2", "ma 2"],
    "software engineering": ["se"],
    "software engineering 1": ["se1", "se 1"],
    "software engineering 2": ["se2", "se 2"],
    "mensch computer interaktion": ["mci"],
    "mensch-computer-interaktion": ["mci"],
}

# Synonyms of the service engine, in order.
SERVICE_SYNONYMS = {
    "info": "informatik",
    "informatik": "computer science informationstechnologie",
    "wi": "wirtschaftsinformatik",
    "bwl": "betriebswirtschaftslehre",
    "mathe": "mathematik",
    "e-technik": "elektrotechnik",
    "et": "elektrotechnik",
    "mb": "maschinenbau",
    "mensa": "speiseplan essen cafeteria",
    "bib": "bibliothek",
    "spo": "studien prüfungsordnung",
    "bafög": "bafög studienfinanzierung amt",
    "prüfung": "klausur exam prüfungsleistung",
    "bewerbung": "zulassung immatrikulation einschreibung",
    "praktikum": "praxissemester praxisphase",
    "thesis": "bachelorarbeit masterarbeit abschlussarbeit",
}

# Words that route a query.
TIMETABLE_SIGNALS = (
    "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "stundenplan", "vorlesung", "semesterplan", "uhrzeit", "raum",
    "monday", "tuesday", "wednesday", "thursday", "friday", "lecture", "schedule", "timetable",
)
STUDENT_BODY_SIGNALS = ("asta", "stura", "fachschaft", "ernas", "studentisch")
INTENTS = {
    "person": ("prof", "dozent", "sprechstunde", "professor"),
    "document": ("spo", "ordnung", "satzung", "antrag", "formular", "pdf"),
    "timetable": ("stundenplan", "vorlesung", "prüfung", "klausur", "termin"),
}

# Collection weights by query type.
COLLECTION_WEIGHTS = {
    "timetable": {"campus_search": 0.4, "campus_website": 0.2, "starplan_timetable": 2.0, "asta_content": 0.1, "campus_pdfs": 0.1, "usta_content": 0.1},
    "asta": {"campus_search": 0.5, "campus_website": 0.3, "starplan_timetable": 0.1, "asta_content": 2.0, "campus_pdfs": 0.3, "usta_content": 1.5},
    "general": {"campus_search": 1.0, "campus_website": 0.7, "starplan_timetable": 0.3, "asta_content": 0.6, "campus_pdfs": 0.8, "usta_content": 0.6},
}
LEAST_WEIGHT = 0.05

# Fusion, thresholds and sizes.
RRF_K = 60
NON_STRICT_TYPES = ("timetable", "website", "asta")
MIN_RELEVANCE = 0.34
CHALLENGER_DISCOUNT = 0.95
DEDUP_PREFIX = 80
RERANK_POOL = 30
PAGE_SIZE = 10
EVIDENCE_TOP1, EVIDENCE_AVG3 = 0.45, 0.40
BM25_K1, BM25_B = 1.2, 0.75
HASH_BUCKETS = 1_000_000
LONG_CLICK_SECONDS = 20
SUGGESTIONS = 15

# Boilerplate patterns of the crawler and of the cleaning step, in order.
NOISE_PATTERNS = (
    r"AI Suche", r"Hallo, ich bin deine AI Suche.*", r"Häufig gesucht:.*", r"Suchbegriff eingeben", r"Link in Zwischenablage kopiert",
    r"Kopieren", r"Schließen", r"Teilen", r"Facebook", r"LinkedIn", r"Email", r"Url",
)
POST_PATTERNS = (
    r"AI Suche Hallo, ich bin deine AI Suche\. Frage mich etwas!.*$",
    r"^Inhalt Ausblenden.*?Inhalt einblenden\s*",
    r"Teilen Schließen Teilen Facebook LinkedIn Email Url Kopieren Link in Zwischenablage kopiert",
    r"Häufig gesucht: Künstliche Intelligenz & Informatik Bachelor Artificial Intelligence & Data Science",
)

# Weekdays and lecture-fragment rules of the timetable source.
WEEKDAYS = {"MO": "Montag", "TU": "Dienstag", "WE": "Mittwoch", "TH": "Donnerstag", "FR": "Freitag", "SA": "Samstag", "SU": "Sonntag"}
ROOM_CODES = ("G1", "G2", "G3", "G4", "AH", "WIN", "231", "111", "114", "129", "130", "131")
BINARY_EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "gif", "svg", "zip", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "mp3", "mp4", "css", "js", "ico")
