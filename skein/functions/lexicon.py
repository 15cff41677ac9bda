"""Default word lists. Every operator takes its lists as parameters; these are what it takes without."""

from __future__ import annotations

#: Function words that analyses leave out; a short list, meant to be replaced or extended by the corpus at hand.
STOPWORDS = (
    "about", "after", "all", "also", "and", "are", "been", "but", "can", "como", "con", "cual", "cuando", "del", "desde", "donde", "each", "ella",
    "ellos", "entre", "era", "esta", "este", "esto", "for", "from", "fue", "had", "has", "hasta", "have", "her", "his", "into", "its", "las", "los",
    "mas", "more", "muy", "not", "only", "other", "our", "para", "pero", "por", "porque", "que", "ser", "she", "sin", "sobre", "some", "son", "such",
    "sus", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "una", "uno", "very", "was", "were", "what", "when",
    "where", "which", "who", "will", "with", "would", "you", "your",
)

#: Genre -> rank of evidence and its label.
EVIDENCE = {
    "scientific_article": ("peer_reviewed_or_academic_highest", 4),
    "institutional_report": ("government_or_institutional_public_record", 3),
    "industry_report": ("industry_survey_or_report", 3),
    "news": ("specialized_or_journalistic_context", 2),
    "forum": ("professional_practice_discussion", 1),
    "other": ("unclear_low", 0),
}

#: Genre -> place in the flow of a narrative and its label.
FLOW = {
    "forum": (1, "individual_dialogue"),
    "news": (2, "news_media"),
    "institutional_report": (3, "institutional_authority"),
    "industry_report": (4, "technical_or_industry_derivation"),
    "scientific_article": (5, "research"),
    "other": (6, "other_or_unclear_derivation"),
}

#: Genres in the order of tables.
GENRES = ("news", "forum", "institutional_report", "scientific_article", "industry_report", "other")

#: Hints at the premise that a sentence leaves out.
PREMISE_CAUSE = "Supone una relación causal que debe verificarse con evidencia externa."
PREMISE_NORM = "Supone una norma implícita sobre lo que debe hacerse o evitarse."
PREMISE_VALUE = "Supone una valoración compartida que puede no ser universal."
PREMISE_NATURAL = "Naturaliza una premisa que debe hacerse explícita."
NATURAL = ("normal", "natural", "obvio", "obvious", "inevitable")

#: Frames of the driver's corpus, whose invented prose has none of the words below.
PROSE_FRAMES = {"articles": ("the", "der", "die", "las"), "links": ("and", "und", "that"), "places": ("of", "in", "for", "with")}
PROSE_MARKERS = {"first": ("the", "der"), "second": ("that", "que"), "third": ("with", "und")}
PROSE_VERBS = ("is", "was", "are", "es", "ist")


#: Phrases that claim a cause.
CAUSAL = (
    "because", "due to", "as a result", "therefore", "caused", "causes", "causing", "leads to", "led to", "results in", "provokes", "prevents",
    "blocks", "porque", "debido a", "por lo tanto", "como resultado", "causa", "causó", "causo", "provoca", "provocó", "provoco", "genera",
    "generó", "genero", "produce", "impide", "evita", "deriva", "derivó", "derivo", "lleva a",
)

#: Speech act -> markers; the first act with a marker in the sentence counts.
SPEECH_ACTS = {
    "assertive": (
        "afirma", "afirmó", "dice", "dijo", "señala", "señaló", "reporta", "reportó", "sostiene", "asegura", "confirma", "indica", "claims",
        "said", "says", "states", "reports", "argues", "confirms",
    ),
    "directive": (
        "debe", "deben", "exige", "pide", "llama a", "ordena", "recomienda", "prohíbe", "prohibe", "solicita", "should", "must", "requires",
        "urges", "calls for", "demands", "orders", "recommends", "forbids",
    ),
    "commissive": (
        "promete", "prometió", "se compromete", "garantiza", "ofrece", "promises", "pledges", "commits", "guarantees", "offers",
    ),
    "expressive": (
        "lamenta", "celebra", "critica", "rechaza", "teme", "denuncia", "acusa", "regrets", "celebrates", "criticizes", "rejects", "fears",
        "denounces", "accuses",
    ),
    "declarative": (
        "declara", "anuncia", "certifica", "autoriza", "sanciona", "aprueba", "declares", "announces", "certifies", "authorizes", "sanctions",
        "approves",
    ),
}

#: Fallacy -> markers.
FALLACIES = {
    "ad_hominem": (
        "corrupto", "ignorante", "estúpido", "idiota", "criminal", "vendido", "stupid", "idiot", "corrupt", "criminal", "liar",
    ),
    "false_cause": (
        "por eso", "por lo tanto", "therefore", "así que", "so,", "caused by", "la causa es", "the cause is",
    ),
    "slippery_slope": (
        "terminará en", "terminara en", "llevará a", "llevara a", "inevitablemente", "will inevitably", "will lead to", "slippery slope",
    ),
    "false_dichotomy": (
        "o estás con", "o estas con", "o contra", "either you", "either/or", "no hay alternativa", "there is no alternative",
    ),
    "appeal_to_fear": (
        "amenaza", "peligro", "miedo", "terror", "caos", "crisis total", "threat", "danger", "fear", "panic", "chaos",
    ),
    "hasty_generalization": (
        "todos", "todas", "siempre", "nunca", "nadie", "all of them", "always", "never", "nobody", "everyone",
    ),
    "appeal_to_authority": (
        "según expertos", "los expertos dicen", "la ciencia dice", "estudio demuestra", "experts say", "science says", "study proves",
        "authority says",
    ),
}

#: Vector of disinformation -> markers.
VECTORS = {
    "emotional_overflow": (
        "escándalo", "escandalo", "indignante", "terrible", "horror", "pánico", "panic", "outrage", "shocking", "terrible", "horrific",
    ),
    "urgency_pressure": (
        "urgente", "comparte", "antes de que", "no quieren que sepas", "urgent", "share before", "they do not want you to know",
    ),
    "conspiracy_frame": (
        "conspiración", "conspiracion", "agenda oculta", "élite", "elite", "deep state", "hidden agenda", "conspiracy",
    ),
    "scapegoating": (
        "culpa de", "responsables de todo", "enemigos", "invasión", "invasion", "to blame", "enemies", "responsible for everything",
    ),
    "absolute_claim": (
        "siempre", "nunca", "todos", "nadie", "sin duda", "definitivamente", "always", "never", "everyone", "nobody", "undoubtedly", "definitely",
    ),
}

#: Words that count as the verb of a sentence.
VERBS = (
    "es", "son", "fue", "será", "sera", "tiene", "tienen", "hace", "hacen", "causa", "provoca", "genera", "impide", "permite", "rechaza", "apoya",
    "acusa", "afirma", "dice", "anuncia", "recomienda", "exige", "promete", "is", "are", "was", "were", "will", "has", "have", "causes",
    "generates", "prevents", "allows", "rejects", "supports", "accuses", "claims", "says", "announces", "recommends", "demands", "promises",
)

#: Part of an argument frame -> markers.
FRAME_PARTS = {
    "problem": (
        "problema", "riesgo", "crisis", "conflicto", "daño", "peligro", "prejuicio", "estigma", "ilegal", "infección", "infeccion", "alergia",
        "problem", "risk", "crisis", "conflict", "harm", "danger", "stigma", "illegal", "infection",
    ),
    "culprit": (
        "culpa", "culpable", "responsable", "causa", "provoca", "por", "debido a", "blame", "responsible", "causes", "caused by", "due to",
    ),
    "solution": (
        "solución", "solucion", "resolver", "medida", "regulación", "regulacion", "propuesta", "recomienda", "debe", "prevención", "prevencion",
        "solution", "measure", "regulation", "proposal", "recommends", "should", "must", "prevention",
    ),
    "urgency": (
        "urgente", "ahora", "inmediato", "antes de", "pronto", "alerta", "hoy", "urgent", "now", "immediate", "before", "soon", "alert", "today",
    ),
}

#: Stage of a narrative event -> markers.
EVENT_STAGES = {
    "initial_event": (
        "began", "started", "announced", "reported", "launched", "introduced", "emerged", "inició", "inicio", "comenzó", "comenzo", "anunció",
        "anuncio", "reportó", "reporto", "lanzó", "lanzo", "surgió", "surgio", "apareció", "aparecio",
    ),
    "conflict": (
        "conflict", "problem", "issue", "concern", "controversy", "tension", "risk", "error", "failure", "dispute", "crisis", "criticism",
        "challenge", "conflicto", "problema", "crítica", "critica", "controversia", "tensión", "tension", "riesgo", "error", "fallo", "falla",
        "disputa", "crisis", "reto",
    ),
    "turning_point": (
        "however", "but", "nevertheless", "nonetheless", "shift", "changed", "after", "later", "then", "instead", "despite", "sin embargo",
        "pero", "no obstante", "cambió", "cambio", "después", "despues", "luego", "a partir", "en cambio", "pese a",
    ),
    "resolution": (
        "solution", "resolved", "response", "strategy", "measure", "proposal", "recommendation", "mitigate", "address", "implemented", "adopted",
        "solución", "solucion", "resolvió", "resolvio", "respuesta", "estrategia", "medida", "propuesta", "recomendación", "recomendacion",
        "mitigar", "atender", "implementó", "implemento", "adoptó", "adopto",
    ),
    "consequences": (
        "therefore", "as a result", "consequence", "impact", "effect", "led to", "resulted", "outcome", "caused", "increased", "decreased",
        "por lo tanto", "como resultado", "consecuencia", "impacto", "efecto", "derivó", "derivo", "provocó", "provoco", "generó", "genero",
        "resultado", "aumentó", "aumento", "disminuyó", "disminuyo",
    ),
}

#: Terms of localisation.
MEXICO_TERMS = (
    "cdmx", "ciudad de mexico", "ciudad de méxico", "conacyt", "conahcyt", "edomex", "estado de mexico", "estado de méxico", "guadalajara", "ipn",
    "mexican", "mexicana", "mexicanas", "mexicano", "mexicanos", "mexico", "monterrey", "méxico", "puebla", "queretaro", "querétaro",
    "tec de monterrey", "uam", "uanl", "unam",
)

#: Terms of the wider region.
LATAM_TERMS = (
    "america latina", "américa latina", "argentina", "bolivia", "brasil", "brazil", "chile", "colombia", "costa rica", "ecuador", "el salvador",
    "guatemala", "honduras", "latam", "latin america", "latinoamerica", "latinoamérica", "panama", "panamá", "paraguay", "peru", "perú",
    "uruguay", "venezuela",
)

#: Terms of approval.
POSITIVE = (
    "acceptance", "accepted", "aceptacion", "aceptación", "aceptado", "admiracion", "admiración", "admiration", "alegria", "alegría", "apoyo",
    "atractivo", "autonomia", "autonomy", "autonomía", "beautiful", "beauty", "belleza", "beneficio", "benefit", "bienestar", "care",
    "celebracion", "celebración", "celebration", "confianza", "confidence", "creative", "creatividad", "creativity", "cuidado", "deseable",
    "desirable", "digno", "empoderamiento", "empowerment", "expresion", "expresión", "expression", "favorable", "feliz", "freedom", "happy",
    "identidad", "improvement", "inclusion", "inclusión", "libertad", "mejora", "orgullo", "positive", "positivo", "pride", "recognition",
    "reconocimiento", "respect", "respeto", "safe", "seguro", "solidaridad", "solidarity", "trust", "valioso", "valor", "valuable", "wellbeing",
)

#: Terms of disapproval.
NEGATIVE = (
    "abuse", "abuso", "alarm", "alarma", "alergia", "allergy", "amenaza", "arrepentimiento", "attack", "castigo", "concern", "conflict",
    "conflicto", "contagio", "controversia", "controversy", "crime", "crimen", "critica", "criticism", "crítica", "damage", "danger", "daño",
    "delito", "desconfianza", "discriminacion", "discriminación", "discrimination", "disease", "dolor", "enfermedad", "error", "estigma",
    "exclusion", "exclusión", "failure", "fear", "fracaso", "harm", "ilegal", "illegal", "infeccion", "infección", "infection", "miedo",
    "negative", "negativo", "pain", "peligro", "prejudice", "prejuicio", "problem", "problema", "rechazo", "regret", "rejection", "riesgo",
    "risk", "sancion", "sanción", "stigma", "threat", "violence", "violencia", "vulnerabilidad", "vulnerability",
)

#: Words that invert the next terms.
NEGATIONS = (
    "never", "ni", "no", "not", "nunca", "sin", "without",
)

#: Words that strengthen the next terms.
INTENSIFIERS = (
    "altamente", "bastante", "extremely", "muy", "really", "sumamente", "very",
)

#: Genre -> marks of its addresses and titles, in the order in which they are tried.
GENRE_MARKERS = {
    "scientific_article": (
        "doi.org", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov/pmc", "sciencedirect.com", "springer.com", "link.springer.com", "tandfonline.com",
        "wiley.com", "sagepub.com", "jstor.org", "mdpi.com", "frontiersin.org", "plos.org", "nature.com", "science.org", "arxiv.org",
        "biorxiv.org", "medrxiv.org", "scielo.", "redalyc.org", "dialnet.unirioja.es", "researchgate.net/publication",
    ),
    "industry_report": (
        "survey.stackoverflow.co", "stackoverflow.blog", "developer survey", "github.blog", "octoverse.github.com", "mckinsey.com", "gartner.com",
        "forrester.com", "idc.com", "statista.com", "state of software", "state of dev", "state of ai",
    ),
    "institutional_report": (
        ".gob.mx", "gob.mx", "salud.gob.mx", "cofepris.gob.mx", "dof.gob.mx", "diputados.gob.mx", "senado.gob.mx", "inegi.org.mx", "who.int",
        "paho.org", "unesco.org", "un.org", "oecd.org", "worldbank.org", "government", "secretaria de salud", "secretaría de salud", "cofepris",
        "diario oficial", "norma oficial", "lineamiento", "regulacion sanitaria", "regulación sanitaria",
    ),
    "forum": (
        "reddit.com", "quora.com", "stackexchange.com", "stackoverflow.com", "forum", "forums.", "/forum/", "/forums/", "community.",
        "/community/", "groups.google.com", "discourse.", "tapatalk.com", "medium.com", "substack.com", "wordpress.com", "blogspot.com",
        "tumblr.com", "dev.to", "news.ycombinator.com",
    ),
    "news": (
        "/news/", "/noticias/", "/world/", "/politics/", "/society/", "/science/", "/salud/", "/opinion/", "news", "times", "post", "journal",
        "diario", "jornada", "elpais", "bbc.", "cnn.", "reuters", "apnews", "nytimes", "washingtonpost", "theguardian",
    ),
}

#: Words that no actor's name holds.
ACTOR_NOISE = (
    "abstract", "article", "articles", "articulo", "articulos", "artículos", "body", "case", "city", "conclusion", "conclusiones", "conclusions",
    "discusion", "discussion", "english", "figure", "figures", "global", "introduccion", "introduction", "journal", "method", "methods",
    "metodo", "metodos", "objective", "objectives", "objetivo", "resultados", "results", "revista", "source", "study", "table", 
    "title", "unknown",
)

#: Phrases that no actor's name holds.
ACTOR_NOISE_PHRASES = (
    "area metropolitana", "conclusion the", "global unclear", "metropolitan area", "source international", "source journal",
)

#: Capitalised words that are no actors.
GENERIC_ACTORS = (
    "A", "An", "And", "Article", "Articulo", "Artículo", "As", "At", "But", "By", "Como", "Con", "DE", "DEL", "EL", "EN", "El", "En", "Esta",
    "Estas", "Este", "Estos", "For", "From", "In", "LA", "LAS", "LOS", "La", "Las", "Los", "News", "Noticias", "On", "PARA", "POR", "Para", "Por",
    "Posts", "Relacionados", "Related", "Sin", "TV", "Tambien", "También", "That", "The", "These", "This", "Those", "UN", "UNA", "Un", "Una",
    "With",
)

#: Short names that are actors.
SHORT_ACTORS = (
    "ai", "hcv", "hiv", "ia", "ipn", "oms", "uam", "unam", "ux", "who",
)
