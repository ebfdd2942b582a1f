"""Free text to stable labels: field, profession and law firm.

Every label is an ordered rule over lower-cased text padded with spaces; the
first that matches wins. The keyword lists are fixed values of the data model:
their blanks are significant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import any_contains, first_match, strip
from docketlake.schema import OTHER

# Field keywords, in match order.
FIELD_KEYWORDS: dict[str, tuple[str, ...]] = {
    "CS/AI": ("machine learning", "deep learning", "artificial intelligence", " ai ", "ai/", "nlp", "computer vision", "ml ", "data science", "llm", "reinforcement learning"),
    "Software/Systems": ("software", "distributed systems", "databases", "compiler", "cybersecurity", "security", "networking", "cloud", "devops"),
    "EE/Hardware": ("electrical engineering", "semiconductor", "vlsi", "circuits", "embedded", "signal processing", "photonics", "hardware"),
    "Biology": ("biology", "genomics", "genetics", "neuroscience", "microbiology", "ecology", "molecular biology", "bioinformatics"),
    "Biomedical/Medicine": ("medicine", "clinical", "medical", "biomedical", "pharma", "oncology", "immunology", "public health", "epidemiology", "nursing"),
    "Chemistry": ("chemistry", "chemical engineering", "catalysis", "electrochemistry"),
    "Materials": ("materials science", "materials", "nanomaterials", "polymer", "metallurgy"),
    "Physics": ("physics", "astrophysics", "quantum", "optics", "particle"),
    "Math/Stats": ("mathematics", "statistics", "applied math", "probability", "operations research"),
    "Economics/Finance": ("economics", "finance", "econometrics", "accounting", "actuarial"),
    "Civil/Mechanical": ("civil engineering", "mechanical engineering", "structural", "robotics", "aerospace", "manufacturing", "thermodynamics"),
    "Environmental/Energy": ("environmental", "energy", "renewable", "climate", "sustainability", "petroleum", "geology"),
    "Social Sciences": ("psychology", "sociology", "political science", "education", "linguistics"),
}

# Profession keywords, in match order; a label may come twice.
PROFESSION_KEYWORDS: list[tuple[str, tuple[str, ...]]] = [
    ("PhD Student", ("phd student", "ph d student", "phd candidate", "ph d candidate", "doctoral student", "doctoral candidate", "phd researcher", "phd in", "grad student", "graduate student")),
    ("Professor/Faculty", ("professor", "faculty", "lecturer", "tenure", " tt ", "instructor")),
    ("Data Scientist/Engineer", ("data scientist", "data analyst", "data engineer", "ml engineer", "machine learning engineer", "ai engineer", "applied scientist", "business intelligence", "data science", "statistician", "biostatistician", "quantitative")),
    ("Engineer (other)", ("project developer", "infrastructure developer", "process developer", "energy developer", "renewable developer", "solar developer", "hardware developer")),
    ("Software Engineer", ("software", " swe ", " sde ", "cybersecurity", "security engineer", "hpc engineer", "devops", "solutions architect", "solution architect", "cloud engineer", "backend", "frontend", "full stack", "fullstack", "qa tester", "programmer", "developer")),
    ("Postdoc/Researcher", ("postdoc", "post doc", "postdoctoral", "post doctoral", "research fellow", "research associate", "research scientist", "researcher", "scientist", "research staff", " r d ")),
    ("Physician/Clinician", ("physician", "doctor of", "veterinary", "therapist", "nurse", "clinician", "surgeon", "medical doctor", "dentist", "pharmacist", "physical therapy", " cra ", "resident")),
    ("Engineer (other)", ("engineer", "engineering", "architect")),
    ("Entrepreneur/Founder", ("entrepreneur", "founder", "business owner", "startup", " ceo ", " cto ")),
    ("Finance/Business", ("finance", "banking", " bank ", "investment", "trading", "supply chain", "consultant", "business analyst", "program manager", "product manager", "executive", "strategist", "operations", "accountant", "economist", "analyst", "manager")),
    ("Student (other)", ("student", "master", " msc ", "undergrad")),
]

# Law firms by alias, in match order; words that say nothing; endings without meaning.
FIRM_ALIASES: dict[str, tuple[str, ...]] = {
    "DIY/Self-petition": (" diy ", "self petition", "self petitioned", "self filed", "self file", "pro se", "no lawyer", "no attorney", "without a lawyer", "without an attorney"),
    "Chen/WeGreened": ("wegreen", "we greened", " chen ", "chen immigration", "chen associates", "north america immigration", "greenedway", "greened way"),
    "Ellis Porter": (" ep ", "ellis porter", "ellisporter"),
    "Raju Law": ("raju",),
    "Colombo & Hurd": ("colombo", "columbo", "colombu", " c and h "),
    "Sedaghat Law": ("sedaghat",),
    "Dunn Law": ("dunn", "arkell"),
    "Peak Immigration": ("peak immigration",),
}
SAYS_NOTHING = ("other", "unknown", "not mentioned", "not specified", "none", "n a", "na", "null")
FIRM_ENDINGS = (
    "law firm", "law group", "law offices", "law office", "attorneys at law", "attorneys", "attorney", "and associates", "associates",
    "immigration law", "immigration", "legal", "pllc", "llp", "llc", "p c", "pc", "law",
)


def _labels(text: Column, rules) -> list[tuple[Column, str]]:
    return [(any_contains(text, words), label) for label, words in rules]


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def field_label(raw: Column) -> Column:
    """Null for null and empty text."""
    return F.when(raw != "", first_match(_labels(_padded(F.lower(raw)), FIELD_KEYWORDS.items()), OTHER))


def profession_label(raw: Column) -> Column:
    """Null too for text that says nothing."""
    words = F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "))
    return F.when((raw != "") & ~words.isin(*SAYS_NOTHING), first_match(_labels(_padded(words), PROFESSION_KEYWORDS), OTHER))


def canonical_firm(clean: Column) -> Column:
    """A firm's own name without legal endings; unchanged where there are none, or nothing else.

    Words of up to three letters become upper case, others are capitalised.
    """
    low = strip(F.regexp_replace(F.lower(clean), "[.,]", ""))
    core = F.regexp_replace(low, f"(?: +(?:{'|'.join(FIRM_ENDINGS)}))+$", "")
    recased = F.transform(F.split(F.trim(core), " +"), lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))))
    return F.when((core == low) | (F.trim(core) == ""), clean).otherwise(F.array_join(recased, " "))


def law_firm_label(raw: Column) -> Column:
    clean = strip(F.regexp_replace(raw, r"(?U)\s+", " "))
    words = F.trim(F.regexp_replace(F.replace(F.lower(raw), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    named = first_match(_labels(_padded(words), FIRM_ALIASES.items()), F.when(clean != "", canonical_firm(clean)))
    return F.when((raw != "") & ~words.isin(*SAYS_NOTHING), named)
