"""Word lists, patterns and tables that results depend on, in their natural order."""

# --- fixed values: e-mail rules -------------------------------------------------------------
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
EMAIL_MASK = "***email_hidden***"
CONTEXT_CHARS, STRONG_CONTEXT_CHARS, DEBUG_CHARS = 250, 200, 300
EXCLUDED_LOCAL_PART = r"accommodat|accessib|disability|disabilities|compliance|noreply|no.reply|donotreply|do.not.reply|(?:^|[._-])support|helpdesk|help.desk|fraud|scam|\beeo\b|\bdpo\b|privacy|gdpr"
STRONG_LOCAL_PART = (
    r"apply|application|careers?|recruit\w*|recrut\w*|hiring|jobs?|emploi|candidat\w*|rh|hr|human.?resources?|people.?culture|contact"
    r"|bewerbung\w*|bewerber\w*|karriere|personalgewinnung|personalentwicklung|ausbildung|kontakt|personal|recursoshumanos|talento"
    r"|curriculos?|vagas?|selecao|talentos?|oportunidades?|sollicitati\w*|vacatures?|werkenbij|werken|vacancy"
)
EXCLUDED_CONTEXT = [
    r"accommodations?", r"accessibilit\w*", r"reasonable.{0,20}accommodations?", r"disability", r"disabilities", r"handicap",
    r"mesures?.{0,20}d.adaptation", r"adaptation", r"accessibilité", r"personnes?.{0,20}handicapées?",
    r"fraud", r"scam", r"suspicious", r"legitimacy", r"authenticity", r"phishing", r"spoofing", r"impersonat",
    r"gdpr", r"ccpa", r"\baedt\b", r"pay\s+transparency", r"your\s+(?:personal\s+)?data\s+(?:is|are|may\s+be)\s+process\w*",
    r"data\s+protection\s+(?:officer|law|regulation|act|policy)", r"data\s+retention", r"local\s+law\s+\d+",
    r"privacy\s+(?:notice|policy|statement)", r"equal\s+employment\s+opportunity", r"institutional\s+equity",
    r"not\s+accept\w*\s+applications?\s+(?:via|by|through|over)\s+email", r"ejercicio\s+de\s+(?:sus|tus)\s+derechos\b",
    r"supresión\b", r"your\s+personal\s+data\b", r"dados\s+pessoais\b", r"lei\s+geral\s+de\s+proteção",
    r"persoonsgegevens\b", r"privacybeleid\b", r"gegevensbescherming\b",
]
APPLY_CONTEXT = [
    r"apply", r"applying", r"application", r"applicants?", r"submit", r"submission", r"send.{0,30}(?:resume|cv|application|candidature)",
    r"email.{0,30}(?:resume|cv|application|candidature)", r"resume", r"curriculum vitae", r"\bcv\b", r"cover.?letter",
    r"contact", r"staffing", r"recruit\w*", r"inquir\w*", r"emailing", r"reach\s+out", r"more\s+information", r"learn\s+more",
    r"postuler", r"appliquer", r"candidature", r"soumettre", r"envoyer.{0,30}(?:cv|candidature|courriel)", r"faire.{0,10}demande",
    r"Bewerbung\w*", r"bewerben", r"bewirb\w*", r"Lebenslauf", r"sende.{0,40}Unterlagen", r"schicke.{0,40}Unterlagen",
    r"zukommen\s+lassen", r"Kontakt\b", r"Ansprechpartner\w*", r"Ansprechperson", r"E-Mail\s*:", r"Rückfragen", r"Auskünfte?\w*",
    r"Noch\s+Fragen\b", r"Haben\s+Sie\s+(?:noch\s+)?Fragen\b", r"Für\s+(?:Rück)?[Ff]ragen\b", r"Bei\s+[Ff]ragen\b",
    r"Fragen\s+beantworten\b", r"wenden\s+Sie\s+sich\b", r"melden\s+Sie\s+sich\b", r"wende\s+(?:dich|Dich)\b", r"melde\s+(?:dich|Dich)\b",
    r"steh[et]n?\s+(?:Ihnen|dir|euch|uns)\b", r"Personalreferent\w*", r"Talent\s+Acquisition", r"(?:per|via|über)\s+E-Mail\b",
    r"Du\s+erreichst\b", r"erreichst\s+(?:Du|mich|uns)\b", r"[Aa]plica\b", r"[Pp]ostula\b", r"[Pp]ostúlate\b",
    r"[Ee]scr[íi]benos?\b", r"[Ee]nv[íi]a(?:me|nos)?\b", r"[Cc]orreo\s*:", r"[Cc]ontacto\b", r"[Cc]andidatura\b", r"[Hh]oja\s+de\s+vida\b",
    r"[Rr]eclutando\b", r"[Rr]eclutamiento\b", r"send\s+an?\s+email\s+to\b", r"[Ee]nvi(?:e|ar|[ao])\b", r"[Ee]nviadas?\b", r"[Ee]mail\s*:",
    r"[Cc]urr[íi]culos?\b", r"[Cc]\.V\.", r"[Cc]andidaturas?\b", r"[Cc]andidate-se\b", r"[Cc]andidatar(?:-se)?\b", r"[Ii]nteressad[oa]s?\b",
    r"[Vv]agas?\b", r"[Cc]ontacto\b", r"[Cc]ontacte\b", r"[Cc]ontate\b", r"[Rr]ecrutamento\b", r"[Pp]elo\s+e-?mail\b", r"[Pp]or\s+e-?mail\b",
    r"sollicit\w+", r"[Ss]tuur\b", r"[Ss]turen\b", r"[Mm]ail\w*\b", r"[Vv]acature[s]?\b", r"[Vv]raag\b", r"[Vv]ragen\b", r"[Ii]nformatie\b",
    r"[Ww]erving\b", r"[Rr]eageer\w*\b", r"[Pp]ersoneels\w+\b", r"[Ff]unctie\b", r"[Рр]езюме\b", r"[Нн]адсила\w+\b", r"[Вв]ідправ\w+\b",
    r"пиши\b", r"пишіть\b", r"зв.язатися\b", r"лист\w*\s+на\b", r"βιογραφικ\w+", r"αποστολ\w+", r"αποστείλ\w+", r"στείλ\w+", r"αίτησ\w+",
    r"[Εε]πικοινων\w+", r"kontakt\w*", r"ansøg\w+", r"spørgsmål\b", r"stilling\w+", r"rekrutter\w+",
]

# --- fixed values: dates ----------------------------------------------------------------------
FR_MONTHS = {"janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12}
EN_MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
MONTH_ABBREVIATIONS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
NUMERIC = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
SHORT_NUMERIC = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{2})\b"
ISO = r"(\d{4})-(\d{2})-(\d{2})"
DAY_MON = r"(\d{1,2})-([A-Za-z]{3})-(\d{4})"
ORDINAL = r"(?i)(\d{1,2})(?:st|nd|rd|th)\s+([A-Za-z]+)\s+(\d{4})"
DAY_MONTH = r"(?iu)(\d{1,2})\s+([a-zéûôàî]+)\s+(\d{4})"
MONTH_DAY = r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
PARTIAL = r"(?i)\b([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?\b(?!\d)"
OPEN_ENDED = r"^\s*(ongoing|until\s+filled|open)\s*$"
DEADLINE_LABELS = [
    r"application\s+deadline", r"unposting\s+date", r"(?:job\s+)?posting\s+down\s+date", r"closing\b", r"close\s+date", r"deadline",
    r"position\s+closes", r"apply\s+(?:by\s+date|before)", r"posting\s+(?:closes|end\s+date|expiration\s+date)",
    r"job\s+posting\s+(?:end|expiration)\s+date", r"applications?\s+(?:will\s+)?close", r"applications?\s+due", r"expir(?:y|ation)\s+date",
    r"application\s+window\b.{0,60}close\b", r"(?:position|job|work)\s+start\s+date", r"(?:hired|offered)\b.{0,120}(?:between|from)\b.{0,120}\band\b",
    r"open\s+until", r"posted\s+until", r"no\s+later\s+than", r"prior\s+to\b", r"ends\s+on", r"accepted\s+through",
    r"applications?\s+received\s+by", r"last\s+(?:day\s+to\s+apply|application\s+date)", r"date\s+limite\s+(?:pour\s+)?(?:postuler|de\s+candidature)?",
    r"date\s+de\s+(?:cl[oô]ture|fermeture)", r"date\s+de\s+fin\s+d['’]affichage\b", r"date\s+d['’]affichage\b", r"fin\s+d[e]\s+l['’]affichage\b",
    r"fin\s+d['’]affichage\b", r"p[eé]riode\s+d['’]inscription\b", r"avant\s+le", r"candidatures?\s+re[cç]ues?\s+jusqu(?:['’]|\s+)au",
    r"fermeture\s+du\s+concours", r"[eé]ch[eé]ance\s+(?:de\s+l['’]affichage\b)?", r"au\s+plus\s+tard\s+le", r"(?:cette\s+offre\s+)?expirer[a]?\s+le",
    r"offre\s+(?:se\s+termine|valide\s+jusqu(?:['’]|\s+)au)",
]
INLINE_APPLY_BY = r"apply\s+(?:\w+\s+){0,3}by\s*(.*)"
INLINE_RESUME_BY = r"r[eé]sum[eé]s?\s+by\s*(.*)"
INLINE_SUBMIT_BY = r"submit\w*\s+(?:(?!by[\s,])\S+\s+){0,8}by\s*(.*)"
INLINE_CLOSE_ON = r"(?:(?:job|this)\s+)?(?:posting|position)\s+(?:will\s+)?(?:close[sd]?|expire[sd]?)\b.{0,60}?\bon\b\s*(.*)"
INLINE_ACCEPTED_UNTIL = r"accept(?:ed|ing\s+\w+)\s+until\s*:?\s*(.*)"
BY_LINE, AU_LINE = r"^\s*by\s*(.*)", r"^\s*au\s*(.*)"
BY_LINE_CONTEXT = r"\bsubmit|send\b.{0,20}\bresume|apply\b|application\b|candidature\b"
START_LABELS = [
    r"start\s+date", r"starting\s+date?", r"date\s+de\s+d[eé]but", r"full\s+consideration(?:\s+date)?", r"begin(?:ning)?\s+on", r"end(?:ing)?\s+on",
    r"start(?:s)?\s+on", r"term\s+(?:start|end)", r"date\s+d['’]entr[eé]e\s+en\s+fonction",
]
START_CONTEXT = (
    r"start\s+date|start(?:ing)?\s*(?:date)?|available\s+(?:from|date)?|date\s+de\s+d[eé]but|disponible\s+(?:le|à\s+partir)"
    r"|full\s+consideration(?:\s+date)?|begin(?:ning)?\s+on|end(?:ing)?\s+on|start(?:s)?\s+on|term\s+(?:start|end)|entr[eé]e?\s+en\s+fonction|fixed\s+to\b|\bdu\s*$"
)

# --- fixed values: titles -----------------------------------------------------------------------
TITLE_STRIP = [
    ("salary symbol", r"[$€£]\s?\d[\d,k.]*\s?(/hr|/hour|/yr|/year|ph|pa)?"),
    ("salary up to", r"\bup\s?to\s?[$€£]\s?[\d,k.]+\b"),
    ("hash code", r"\s*#[A-Z]{2,6}\b"),
    ("numeric code", r"\(\s*\d{4}[-–]\d{2,6}\s*\)"),
    ("employment type", r"full[\s-]?time|part[\s-]?time|casual|\btemporary\b|\btemp(?!\w)\b|fixed[\s-]?term|\bpermanent(?!\s+reliever)\b|perm(?!\w)|on[\s-]?call|sur appel"),
    ("early careers", r"early careers?|new\s?grad(uate)?"),
    ("campaign", r"apply\s+now|hiring\s+now|no\s+experience\s+needed|start\s+your\s+career\s+with\s+us\s+today[!?]*|possibility\s+for\s+conversion\s+to\s+perm"),
    ("multiple positions", r"\(?\bmultiple\s+positions?\b\)?"),
    ("opportunities", r"\bopportunities\b"),
]
SUFFIX_LETTERS = "[mMwWfFdDhHxXiI]"
