"""Tables that results hang on.  All are fixed values and defaults: functions take others."""

from __future__ import annotations

# Short forms written out before titles are compared.
ABBREVIATIONS = {
    "sqa": "software quality assurance", "qa": "quality assurance", "qc": "quality control",
    "mis": "management information systems", "mto": "management trainee officer", "erp": "enterprise resource planning",
    "dba": "database administrator", "ba": "business analyst", "sa": "systems analyst", "it": "information technology",
    "is": "information systems", "sw": "software", "dev": "developer", "engr": "engineer", "exec": "executive",
    "mgmt": "management", "admin": "administrator", "sde": "software development engineer",
    "sdet": "software development engineer in test",
}

# Short forms written out before titles are scored.
SCORE_ABBREVIATIONS = {
    "mto": "management trainee officer", "sqa": "software quality assurance", "qa": "quality assurance",
    "mis": "management information systems", "it": "information technology", "ba": "business analyst",
}

# Words left out of company names, of titles, and words of seniority (patterns).
COMPANY_NOISE = (
    "ltd|limited|pvt|private|plc|inc|incorporated|llc|co|company|corp|corporation|group|holdings|industries|enterprise|"
    "enterprises|international|intl|bd|bangladesh|sister concern|a concern of|it|technologies|technology|tech|solutions|"
    "solution|software|systems|services|service"
)
TITLE_NOISE = (
    "urgent|urgently|hiring|we are hiring|immediate|walk in|walk-in|apply now|vacancy|vacancies|opening|openings|required|"
    "wanted|full time|full-time|part time|part-time|contractual|permanent|male|female|freshers?|fresh graduates?"
)
SENIORITY = (
    "junior|jr|senior|sr|lead|principal|head|chief|associate|assistant|asst|trainee|intern|internship|entry level|"
    "entry-level|mid level|mid-level|i{1,3}|l[1-5]|level [1-5]"
)

# Titles that count as senior or junior when levels are scored (patterns).
SENIOR_TITLE = "senior|sr|lead|principal|staff|head|director|architect|manager|chief|vp"
JUNIOR_TITLE = "junior|jr|trainee|intern|internship|fresher|freshers|graduate|entry"

# Words that are no terms.
STOP_WORDS = (
    "and or the a an to of in for with on at from by is are be as this that will can should experience knowledge skills "
    "skill requirements responsible preferred plus using use ability excellent strong good candidate job role position "
    "company years year"
).split()

# Query parameters, by how their names begin, that say nothing about the page.
TRACKING = "utm_|trk|trackingid|ref|refid|src|source|fbclid|gclid|mc_|lipi|eb|_l|origin|alid|jsrc|from|vjk|tk|jk_?src|sponsored"

# Currency, units and phrases of pay.
CURRENCY, UNIT = "tk|bdt|taka|৳", "k|thousand|lakh|lac"
NEGOTIABLE = "negotiab|as per (company )?polic|industry standard|competitive"
PAY_HINT = r"salary|remuneration|compensation|\btk\b|\btaka\b|\bbdt\b|৳|negotiab"

# Statuses a person works on; the score weights and level scores; thresholds.
ACTIVE_STATUSES = ["Saved", "Awaiting Approval", "Applied", "Interview", "Offer"]
SCORE_WEIGHTS = {"title": 40, "level": 25, "skills": 25, "preference": 10}
TITLE_JACCARD, SIMHASH_DISTANCE, RETENTION_DAYS, HEALTH_THRESHOLD = 0.72, 6, 45, 4
HOME = (23.7639, 90.3931)
EARTH_KM = 6371.0

# What a location without office says, home country's places, other countries (patterns).
REMOTE = "remote|work from home|wfh|anywhere|hybrid"
HOME_COUNTRY = (
    "bangladesh|dhaka|chattogram|chittagong|sylhet|khulna|rajshahi|gazipur|narayanganj|cox'?s bazar|mymensingh|rangpur|"
    "barisal|barishal|comilla|cumilla|bogura|bogra"
)
ABROAD = (
    "united kingdom|uk|england|scotland|wales|united states|usa|us|canada|australia|new zealand|germany|france|netherlands|"
    "belgium|spain|portugal|italy|ireland|sweden|norway|denmark|finland|switzerland|austria|poland|romania|turkey|singapore|"
    "malaysia|indonesia|thailand|vietnam|philippines|japan|china|hong kong|south korea|india|pakistan|nepal|sri lanka|"
    "maldives|uae|united arab emirates|dubai|abu dhabi|saudi arabia|qatar|kuwait|oman|bahrain|egypt|nigeria|kenya|"
    "south africa|brazil|mexico"
)

# Formats in which dates are read (a day's name before them is dropped), in the order they are tried.
DATE_FORMATS = [
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "M/d/yyyy",
    "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss'Z'",
]

# Categories in the order in which ties are settled, with their weights and keys.
DEFAULT_CATEGORY = "Information Technology"
CATEGORY_RULES = [
    ("Software Development", 3, ["software engineer", "software developer", "software development", "web developer", "php developer", "full stack", "frontend", "front end", "backend", "back end", "application developer", "programmer", "java developer", "python developer", "laravel", "node.js", ".net", "react developer", "android developer", "flutter", "mobile app developer"]),
    ("Management & Business", 2, ["management trainee", "trainee officer", "business development", "marketing executive", "operations executive", "project coordinator", "sales executive", "relationship officer", "relationship manager", "supply chain", "human resource", "hr executive", "mba"]),
    ("Software Quality Assurance", 3, ["quality assurance", "sqa", "software tester", "test engineer", "qa engineer", "qa analyst", "test case", "manual testing", "automation testing", "selenium", "test automation", "bug tracking", "regression testing", "sdet", "qc engineer"]),
    ("MIS", 3, ["mis", "management information system", "management information systems", "mis executive", "mis officer", "reporting officer", "data entry", "record keeping"]),
    ("Information Systems", 2, ["information systems", "systems analyst", "system analyst", "erp", "system design", "requirement analysis", "business systems"]),
    ("Data & Reporting", 2, ["data analyst", "data operations", "data engineer", "business intelligence", "reporting analyst", "power bi", "tableau", "dashboard", "sql report", "data visualisation", "data visualization", "analytics"]),
    ("Business Analysis", 2, ["business analyst", "requirement gathering", "brd", "srs", "stakeholder", "process improvement", "gap analysis"]),
    ("Application Support", 2, ["application support", "technical support", "service desk", "helpdesk", "help desk", "l1 support", "l2 support", "support engineer", "troubleshoot"]),
    ("Information Technology", 1, ["it officer", "it executive", "it support", "network", "hardware", "server", "system admin", "database administrator", "it operations", "infrastructure"]),
]

# Cues and headings that set a line's section or tier (patterns, first match wins).
SECTIONS = [
    ("preferred", r"prefer(?:red|ably)?|nice to have|good to have|bonus|desirable|advantage|plus points?|added advantage"),
    ("ignore", r"about (?:us|the (?:company|organi[sz]ation|opportunity)|our (?:company|team))|who we are|our (?:story|culture|values|mission)|life at|company (?:overview|profile|description)|benefits?|perks|compensation|what we offer|why join|how to apply|to apply|equal opportunity|contact|application (?:deadline|process|procedure)|deadline"),
    ("required", r"requirements?|qualifications?|skills?|competenc(?:y|ies)|must[- ]haves?|what you(?:'ll| will)? (?:need|bring)|looking for|who you are|about you|your profile|eligibility|education(?:al)?|experience|technical|expertise|proficienc(?:y|ies)"),
    ("duties", r"responsibilit(?:y|ies)|duties|what you(?:'ll| will)?(?: be)? (?:do|doing)|role|key tasks|job (?:description|summary|highlights|context)|summary|scope|day to day|activities|overview|highlights|opportunity"),
]
PLAIN_LABELS = r"(?i)^(location|employment(?: type| status)?|vacanc(?:y|ies)|no\.? of vacanc\w+|salary|deadline|application deadline|age|gender|department|job nature|job type|headquarters|url|category|posted|published|apply(?: before| by)?|workplace|working (?:days|hours))$"
# Whole-line headings written as sentences; statements of equal opportunity; lines that read as headings (patterns).
PHRASES = r"(?i)^(?:what (?:you(?:'ll| will)?(?: be)? (?:need|bring|do|doing)|we(?:'re| are) looking for)|who you are|about you|your (?:profile|background|skills)|(?:the )?(?:role|job|position)|(?:nice|good) to have|bonus points?|must[- ]haves?|responsibilities|requirements|qualifications|key skills|how we work|why (?:join|work)\b.*)\??$"
EQUAL = r"(?i)equal (?:employment )?opportunity|non-?discriminat|without regard to|protected (?:class|status|veteran)|affirmative action|reasonable accommodations?"
HEADING_LIKE = "^[A-Z][^.!?,;:]{0,58}$"
# Cues of wishes and of musts; years asked, and ages, which are none (patterns).
CUE_NICE = r"(?i)\b(prefer(?:red|ably)?|nice to have|good to have|a plus|plus point|bonus|advantage|desirable|optional|an asset|not mandatory)\b"
CUE_MUST = r"(?i)\b(must|required|requirement|mandatory|essential|minimum|need(?:s|ed)? to|should have|proficien(?:t|cy)|strong (?:knowledge|understanding|experience|command|background)|hands[- ]on|expert(?:ise)?|solid (?:knowledge|understanding|experience))\b"
YEARS = r"(?i)(\d+)\s*(?:\+|[–—-]\s*\d+|to\s*\d+)?\s*(?:years?|yrs?)\b"
AGE = r"(?i)\bage(?:d)?\b|\byears?\s+old\b"

# Where a line is cut into phrases, how a line points at a skill, how sentences begin, endings of things (patterns).
PHRASE_BREAK = r"""[,;:()\[\]{}"|!?•–—/]|\s[&+]\s|\.(?:\s|$)"""
LEAD_IN = (
    r"(?i)^(?:(?:strong|good|solid|excellent|basic|working|hands[- ]on|proven|demonstrated|in[- ]depth|thorough|sound|advanced|practical|prior|relevant|deep|fluent|proficient|extensive|previous)\s+)*"
    r"(?:knowledge|understanding|experience|proficiency|expertise|skills?|familiarity|command|background|exposure|competenc(?:y|ies)|ability|capabilit(?:y|ies))\s+(?:of|in|with|on|using|around)\s+"
)
SENTENCE_START = r"(?i)^(?:the|our|we|you|your|it|they|this|that|these|those|he|she|there|as|if|when|while|for|i)\b"
NOUN_ENDING = r"(?i)(tion|sion|ment|ance|ence|ity|ing|ship|ology|ics|ism|ure|age|ery|ory|ist|ware)s?$"
# Acronyms and place words that are no skills.
PLAIN_ACRONYMS = (
    "USA UK UAE BD BDT TK CV PDF MD AM PM ASAP FAQ PLC LTD LLC INC CEO CFO CTO COO HQ NYSE ARR YOY EMEA APAC US EU ID OK NO YES II III IV SR JR EEO CGPA GPA NID HR OR AND THE FOR NOT ALL "
    "ANY BSC MSC PHD SSC HSC MT MTO GM AGM DGM VP SVP EVP CA&C P&C"
).split()
PLACE_WORDS = (
    "dhaka dhanmondi gulshan banani uttara mirpur mohakhali motijheel tejgaon badda gazipur narayanganj savar chattogram chittagong khulna rajshahi sylhet barishal barisal rangpur mymensingh "
    "comilla cumilla bogura bogra jashore jessore cox bazar bangladesh mirsarai nsez beza epz asia europe america africa london singapore malaysia india pakistan usa"
).split()

# Documents a post may ask for: key, name, and the pattern that shows it.
DOCUMENTS = [
    ("cv", "Resume / CV", r"\b(resume|cv|curriculum vitae)\b"),
    ("cover", "Cover letter", r"\b(cover(?:ing)? letter|motivation letter|letter of interest)\b"),
    ("photo", "Recent photograph", r"\b(photograph|passport[- ]size (?:photo|picture)|recent photo)\b"),
    ("nid", "National ID / passport copy", r"\b(national id|nid\b|passport copy|copy of (?:your )?passport)"),
    ("academic", "Academic certificates / transcripts", r"\b(academic (?:certificate|transcript)s?|transcripts?|mark ?sheets?|educational certificates?|testimonials?)\b"),
    ("experience", "Experience certificate", r"\bexperience (?:certificate|letter)s?\b"),
    ("expsalary", "Expected salary stated in the application", r"\b(expected salary|salary expectation|expected pay)\b"),
    ("cursalary", "Current salary stated in the application", r"\b(current salary|present salary)\b"),
    ("portfolio", "Portfolio / work samples / GitHub", r"\b(portfolio|work samples?|github)\b"),
    ("refs", "References", r"\b(references?|referees?)\b"),
]

# Codes of employment and what they are called.
EMPLOYMENT = {"FULL_TIME": "Full time", "PART_TIME": "Part time", "CONTRACTOR": "Contract", "TEMPORARY": "Temporary", "INTERN": "Internship", "VOLUNTEER": "Volunteer"}
# What an address says where it says nothing; lines of alert mails that are no titles (pattern).
PLACEHOLDERS = ["-", "n/a", "na", "none", "null", "not specified", "unspecified", "not mentioned"]
MAIL_NOISE = r"(?i)^(view job|apply now|see all jobs|unsubscribe|see more jobs|view all|easy apply|be an early applicant|actively recruiting|\d+ new jobs?)$"

# Places with latitude and longitude.
AREAS = {
    "tejgaon": (23.7639, 90.3931), "tejgaon industrial area": (23.7660, 90.3990), "nakhalpara": (23.7700, 90.3930),
    "farmgate": (23.7580, 90.3897), "karwan bazar": (23.7509, 90.3934), "kawran bazar": (23.7509, 90.3934),
    "panthapath": (23.7515, 90.3840), "banglamotor": (23.7448, 90.3942), "shahbagh": (23.7389, 90.3956),
    "segunbagicha": (23.7350, 90.4030), "kakrail": (23.7385, 90.4050), "paltan": (23.7350, 90.4120),
    "bijoynagar": (23.7361, 90.4085), "motijheel": (23.7330, 90.4172), "dilkusha": (23.7290, 90.4170),
    "shantinagar": (23.7400, 90.4126), "malibagh": (23.7481, 90.4160), "moghbazar": (23.7480, 90.4060),
    "mouchak": (23.7460, 90.4110), "rampura": (23.7614, 90.4204), "banasree": (23.7620, 90.4290),
    "khilgaon": (23.7500, 90.4260), "hatirjheel": (23.7560, 90.4060), "niketan": (23.7772, 90.4106),
    "mohakhali": (23.7784, 90.4033), "mohakhali dohs": (23.7830, 90.3980), "banani": (23.7936, 90.4043),
    "banani dohs": (23.7960, 90.3990), "gulshan": (23.7925, 90.4078), "gulshan 1": (23.7806, 90.4152),
    "gulshan 2": (23.7936, 90.4147), "baridhara": (23.8043, 90.4207), "baridhara dohs": (23.8080, 90.4180),
    "badda": (23.7806, 90.4256), "aftabnagar": (23.7690, 90.4330), "bashundhara": (23.8199, 90.4275),
    "bashundhara r a": (23.8199, 90.4275), "kuril": (23.8235, 90.4200), "nikunja": (23.8288, 90.4150),
    "khilkhet": (23.8290, 90.4230), "uttara": (23.8759, 90.3795), "airport": (23.8433, 90.3978),
    "cantonment": (23.8050, 90.3900), "kafrul": (23.7930, 90.3830), "agargaon": (23.7780, 90.3770),
    "sher e bangla nagar": (23.7690, 90.3800), "mirpur": (23.8060, 90.3684), "mirpur dohs": (23.8290, 90.3706),
    "pallabi": (23.8240, 90.3650), "kazipara": (23.7940, 90.3720), "shewrapara": (23.7890, 90.3720),
    "kallyanpur": (23.7787, 90.3600), "shyamoli": (23.7740, 90.3652), "adabar": (23.7714, 90.3576),
    "mohammadpur": (23.7592, 90.3585), "lalmatia": (23.7549, 90.3676), "dhanmondi": (23.7461, 90.3742),
    "jigatola": (23.7400, 90.3740), "elephant road": (23.7386, 90.3856), "new market": (23.7331, 90.3841),
    "azimpur": (23.7290, 90.3860), "lalbagh": (23.7190, 90.3880), "old dhaka": (23.7100, 90.4070), "wari": (23.7180, 90.4180),
    "sadarghat": (23.7060, 90.4100), "jatrabari": (23.7100, 90.4350), "demra": (23.7180, 90.4700), "keraniganj": (23.7000, 90.3800),
    "savar": (23.8583, 90.2667), "ashulia": (23.9100, 90.3200), "gazipur": (23.9999, 90.4203), "tongi": (23.8930, 90.4030),
    "narayanganj": (23.6238, 90.5000), "chattogram": (22.3569, 91.7832), "chittagong": (22.3569, 91.7832),
    "sylhet": (24.8949, 91.8687), "rajshahi": (24.3745, 88.6042), "khulna": (22.8456, 89.5403),
}

# Patterns of application texts (several tasks at once, praise of the company, farewells,
# where a bullet may be cut, words it may not end in).
MULTITASK = r"(?i)multi[-\s]?task|multiple (?:tasks|priorities|projects)|several (?:tasks|projects)"
BLURB = r"(?i)^(we|our|the company|this is)\b|\b(is|are) (offering|looking|seeking|hiring|recruiting)\b"
FAREWELL = r"(?is)\n\s*(Sincerely|Best regards|Kind regards|Yours sincerely|Regards),?[ \t]*(\n.*|\s*)\z"
CLAUSE_ENDS = ", |; | by | covering | while | and "
TAIL_WORDS = "and|or|of|the|a|an|to|for|with|by|in|on|at|as|from"

# What rule gates say.
PAY_TOPS_OUT, PAY_STARTS, PAY_FLOOR = "Pay tops out at Tk ", "Starts at Tk ", ", below your Tk {} floor"
PAY_UNKNOWN, AREA_UNKNOWN = "Pay not stated, worth asking before you invest time", "Exact area not stated in the posting"
FAR, FAR_LIMIT = " is about ", " km out, past your {:g} km limit"
ABROAD_FROM, ABROAD_NOTE, EXCLUDED_NOTE = "Based in ", ", outside Bangladesh", "Title matches your excluded list ({})"
