"""Fixed values.

Everything in this file is a constant that results depend on: vocabularies,
default patterns, weights and labels. There is no logic here.
"""

# --- Fixed values: sections ---------------------------------------------------
SECTION_WEIGHTS = {
    "title": 5,
    "abstract": 4,
    "methods": 6,
    "results": 5,
    "discussion": 2,
    "conclusion": 2,
    "introduction": 1,
    "references": -3,
    "other": 1,
}
SECTION_HEADERS = {
    "title": [],
    "abstract": [r"(?im)^\s*(abstract|resumen)\b"],
    "introduction": [r"(?im)^\s*(\d+[\.\)]?\s*)?(introduction|introducci[oó]n|background|antecedentes)\b"],
    "methods": [
        r"(?im)^\s*(\d+[\.\)]?\s*)?((materials?\s+and\s+methods?)|(methods?)|(methodology))\b",
        r"(?im)^\s*(\d+[\.\)]?\s*)?((experimental\s+procedures?)|(study\s+population)|(participants?\s+and\s+methods?))\b",
        r"(?im)^\s*(\d+[\.\)]?\s*)?((materiales\s+y\s+m[eé]todos)|(m[eé]todos))\b",
    ],
    "results": [r"(?im)^\s*(\d+[\.\)]?\s*)?(results?|resultados)\b"],
    "discussion": [r"(?im)^\s*(\d+[\.\)]?\s*)?(discussion|discusi[oó]n)\b"],
    "conclusion": [r"(?im)^\s*(\d+[\.\)]?\s*)?(conclusions?|conclusiones?)\b"],
    "references": [r"(?im)^\s*(references|referencias|bibliography|literature\s+cited)\b"],
    "other": [],
}
CENTRAL_SECTIONS = ("title", "abstract", "methods", "results")
PERIPHERAL_SECTIONS = ("introduction", "discussion", "conclusion")
TERMINAL_SECTION = "references"
HEADER_LINE_CHARS = 60
RUN_IN_MARKS = ".:—–-"
SECTION_PROFILES = {
    "baseline_current": {
        "title": 5, "abstract": 4, "methods": 6, "results": 5, "discussion": 2,
        "conclusion": 2, "introduction": 1, "references": -3, "other": 1,
    },
    "conservative_evidence": {
        "title": 3, "abstract": 3, "methods": 7, "results": 6, "discussion": 1,
        "conclusion": 1, "introduction": 0, "references": -5, "other": 0,
    },
    "neutral_counting": {
        "title": 1, "abstract": 1, "methods": 1, "results": 1, "discussion": 1,
        "conclusion": 1, "introduction": 1, "references": 0, "other": 1,
    },
    "central_sections_only": {
        "title": 1, "abstract": 1, "methods": 1, "results": 1, "discussion": 0,
        "conclusion": 0, "introduction": 0, "references": -1, "other": 0,
    },
}

# --- Fixed values: cues and mention scoring -----------------------------------
CUE_FAMILIES = (
    "exposure", "dose", "association", "strong_association", "speculative",
    "negation", "review", "human", "in_vivo", "in_vitro",
)
MENTION_CUES = ("exposure", "dose", "association", "speculative", "negation")
CUE_POINTS = {"exposure": 4, "dose": 5, "association": 2, "speculative": -1, "negation": -2}
GENERIC_POINTS = -1
EVIDENCE_POINTS = {"association": 4, "strong_association": 4, "speculative": -2, "negation": -4}

# --- Fixed values: roles, kinds, labels ---------------------------------------
ROLE_LABELS = {
    "role_primary_focus": "Foco principal del estudio",
    "role_probable_focus": "Foco probable del estudio",
    "role_secondary_variable": "Variable secundaria o contexto analitico",
    "role_intro_discussion_only": "Mencion solo en introduccion o discusion",
    "role_bibliographic_only": "Mencion solo bibliografica",
    "role_review_mention": "Mencion en revision o sintesis",
    "role_unclear": "Rol no determinado",
}
ROLE_WEIGHTS = {
    "role_primary_focus": 3.0,
    "role_probable_focus": 2.5,
    "role_secondary_variable": 2.0,
    "role_intro_discussion_only": 0.5,
    "role_review_mention": 0.3,
    "role_bibliographic_only": 0.2,
    "role_unclear": 0.5,
}
FREQUENCY_ROLES = (
    "role_primary_focus", "role_probable_focus", "role_secondary_variable",
    "role_intro_discussion_only", "role_review_mention",
)
ASSOCIATION_WEIGHTS = {
    "asociacion_fuerte": 3.0,
    "asociacion_debil": 2.0,
    "mencion_especulativa": 1.0,
    "sin_evidencia_suficiente": 0.0,
}
CONFIDENCE_WEIGHTS = {"Alta": 3.0, "Media": 2.0, "Baja": 1.0}
NO_EVIDENCE = "sin_evidencia_suficiente"
LITERAL = "extraccion_literal"
INFERRED = "inferencia_contextual_con_evidencia_textual"
LITERAL_WITHOUT_RELATION = "extraccion_literal_sin_relacion_directa"
NOT_DETECTED = "no detectado"
NO_CATEGORY = "(sin categoria)"
NO_SECTION = "(sin seccion)"
PRECLINICAL_WORDS = (
    "basic", "preclinical", "preclínico", "preclinico", "experimental", "in vivo", "in vitro",
)
EPIDEMIOLOGY_WORDS = (
    "cohort", "case-control", "case control", "cross-sectional", "cross sectional",
    "longitudinal", "registry", "ecological", "cohorte", "caso-control", "caso control",
    "transversal", "epidemiológic", "epidemiologic", "observacional",
)
STUDY_CONTEXT = {
    "human": "Analizado en poblacion humana o estudio epidemiologico",
    "in_vitro": "Usado en ensayos in vitro",
    "in_vivo": "Usado en ensayos in vivo",
    "review": "Revision o sintesis; no estudio primario",
    "unclear": "No queda claro",
}

# --- Fixed values: metadata and titles ----------------------------------------
DOI_PATTERN = r"\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
YEAR_PATTERN = r"\b(19[5-9]\d|20[0-3]\d)\b"
TITLE_KEYS = ("Paper name", "Title", "title", "col3")
YEAR_KEYS = ("Publication Date", "Year", "year", "publication_year")
DOI_KEYS = ("DOI", "doi")
ID_KEYS = ("ID", "ID2", "article_id", "id")
STUDY_TYPE_KEY = "Study type"
TITLE_STOPWORDS = (
    "study", "studies", "estudio", "estudios", "article", "articulo", "artículo",
    "review", "revision", "revisión", "analysis", "analisis", "análisis", "results",
    "resultados", "effect", "effects", "efecto", "efectos", "between", "entre",
    "relation", "relacion", "relación", "association", "asociacion", "asociación",
    "among", "based", "using", "evidence", "evidencia",
)
TITLE_TOKEN = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñβ]+"
TITLE_BOILERPLATE = (
    "doi", "journal homepage", "www.", "copyright", "received", "accepted",
    "available online", "issn",
)
EMBEDDED_TITLE_PUBLISHERS = ("microsoft", "elsevier", "springer")

# --- Fixed values: analytics ---------------------------------------------------
CLUSTER_FEATURE_PREFIXES = (
    "a_category::", "b_category::", "a_confidence::", "b_confidence::", "article_kind::",
    "relation_association::", "relation_confidence::", "relation_section::",
)
STRENGTH_CUTS = (7.0, 4.0)
SEED = 13

# --- Fixed values: single-variable classifier ----------------------------------
CONTEXT_SECTION_HEADERS = {
    "title_abstract": [r"(?im)^\s*(abstract|resumen)\b"],
    "introduction": [r"(?im)^\s*(\d+\.?\s*)?(introduction|introducci[oó]n)\b"],
    "methods": [
        r"(?im)^\s*(\d+\.?\s*)?((materials?\s+and\s+methods?)|(methods?)|(methodology)|(experimental\s+procedures?)|(study\s+population)|(participants?\s+and\s+methods?)|(materiales\s+y\s+m[eé]todos)|(m[eé]todos))\b"
    ],
    "results": [r"(?im)^\s*(\d+\.?\s*)?(results?|resultados)\b"],
    "discussion": [r"(?im)^\s*(\d+\.?\s*)?(discussion|discusi[oó]n)\b"],
    "conclusion": [r"(?im)^\s*(\d+\.?\s*)?(conclusions?|conclusiones?)\b"],
    "references": [r"(?im)^\s*(references|referencias|bibliography|literature\s+cited)\b"],
}
CONTEXT_SECTION_WEIGHTS = {
    "title_abstract": 4, "methods": 5, "results": 3, "discussion": 2,
    "conclusion": 2, "introduction": 1, "other": 1, "references": -2,
}
CONTEXT_CUES = {
    "exposure": [
        r"\b(expos(?:ed|ure|icion|ición|iciones)|treated|treatment|administered|administration|"
        r"dose|doses|dosage|concentration|concentrations|levels?|measured|measurement|"
        r"serum|urine|urinary|blood|brain|drinking\s+water|well[-\s]?water|waterborne|"
        r"contaminated\s+water|contaminated\s+drinking\s+water|groups?|control\s+group|"
        r"risk|hazard|odds\s+ratio|relative\s+risk|hazard\s+ratio|associated|association|"
        r"oral|gavage|ad\s+libitum|in\s+vivo|in\s+vitro|model|assay|ensayo|grupo|control)\b"
    ],
    "dose": [
        r"(\b\d+(?:[\.,]\d+)?\s*(mg/l|ug/l|µg/l|μg/l|ng/l|ppm|ppb|mg/kg|µm|μm|um|nm|g/l)\b|"
        r"\b(ng/l|µg/l|μg/l|mg/l|ppm|ppb|mg/kg|µm|μm)\b)"
    ],
    "background": [
        r"\b(review|revisi[oó]n|previous\s+studies|prior\s+studies|literature|reported|"
        r"has\s+been\s+associated|have\s+been\s+associated|background|antecedentes|"
        r"hypothesis|suggested|se\s+ha\s+reportado|estudios\s+previos)\b"
    ],
    "review": [
        r"\b(review|systematic\s+review|narrative\s+review|meta[-\s]?analysis|"
        r"revisi[oó]n|metaan[aá]lisis)\b"
    ],
    "epidemiology": [
        r"\b(case[-\s]?control|caso[-\s]?control|cohort|cohorte|cross[-\s]?sectional|transversal|"
        r"longitudinal|registry|registro|ecological|ecol[oó]gico|epidemiol[oó]gico|observacional)\b"
    ],
    "preclinical_metadata": [
        r"\b(preclinical|precl[ií]nico|basic|experimental|in\s+vivo|in\s+vitro|zebrafish|mouse|"
        r"mice|rat|cell\s+line|larvae|experimental)\b"
    ],
    "preclinical_text": [
        r"\b(in\s+vivo|in\s+vitro|zebrafish|mouse|mice|rat|cell\s+line|larvae|experimental)\b"
    ],
}
CONTEXT_CUE_POINTS = {"exposure": 4, "dose": 5, "background": -1}
CONTEXT_CLASSES = (
    "trabajado_como_exposicion_o_ensayo", "posible_secundario", "revision_o_sintesis",
    "mencion_de_contexto", "solo_referencias",
)
CONTEXT_TITLE_STOPWORDS = (
    "the", "and", "for", "with", "from", "between", "relation", "study", "effects", "effect",
    "water", "disease", "exposure", "contaminants", "contaminantes",
)
CONTEXT_TITLE_TOKEN = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñβα]+"
CONTEXT_TITLE_BOILERPLATE = (
    "journal homepage", "www.", "http", "doi:", "copyright", "accepted", "received",
    "available online", "issn", "volume",
)
CONTEXT_TITLE_PUBLISHERS = ("microsoft", "elsevier", "springer", "wiley", "frontiers")
SECTION_REPORT_LABELS = {
    "title": "Titulo",
    "abstract": "Resumen",
    "introduction": "Introduccion",
    "methods": "Metodos",
    "results": "Resultados",
    "discussion": "Discusion",
    "conclusion": "Conclusion",
    "references": "Referencias",
    "unknown": "No detectada",
}

# --- Fixed values: calibration survey -------------------------------------------
SURVEY_PARAMETER = r"^(.*) \(valor actual: (.*)\)$"
SURVEY_PROPOSAL_PREFIX = "Valor propuesto — "
SURVEY_PROFILE_PREFIX = "Perfil"
SURVEY_VOTES = {"mantener": "Mantener", "subir": "Subir", "bajar": "Bajar"}
SURVEY_GRID_ANSWERS = (
    "Bien clasificado", "Debería ir en otro grupo", "No debería estar / sobra", "No sé",
    "(sin responder)",
)
NO_ANSWER = "(sin responder)"
