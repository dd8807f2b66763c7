"""Text, URL and metadata functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules and word lists that results depend on.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
LOGIN_MARKERS = ("login", "signin", "sign-in", "sso", "shibboleth", "saml", "authenticate", "auth/", "identity")
SKIP_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "svg", "ico", "css", "js", "zip", "mp3", "mp4", "docx", "xlsx", "pptx")
ERROR_TITLES = ("page not found", "404 error", "not found")
URL_TYPES = (
    ("/faq", "faq"), ("/frequently-asked", "faq"), ("/polic", "policy"), ("/deadline", "deadline_reference"), ("/dates", "deadline_reference"),
    ("/calendar", "deadline_reference"), ("/news", "news_announcement"), ("/events", "news_announcement"), ("/announcement", "news_announcement"),
    ("/contact", "contact_info"), ("/form", "form"), ("/apply", "how_to_guide"), ("/how-to", "how_to_guide"), ("/steps", "how_to_guide"),
)
TITLE_TYPES = (
    ("faq", "faq"), ("frequently asked", "faq"), ("policy", "policy"), ("policies", "policy"), ("deadline", "deadline_reference"),
    ("news", "news_announcement"), ("contact", "contact_info"), ("form", "form"), ("application", "form"), ("how to", "how_to_guide"), ("steps to", "how_to_guide"),
)
URL_AUDIENCES = (
    ("newstudent.", ("prospective_student",)), ("admissions.", ("prospective_student",)), ("careercenter.", ("current_student", "alumni")),
)
DEPARTMENT_AUDIENCES = (
    ("admissions", ("prospective_student",)), ("career", ("current_student", "alumni")), ("technology services", ("current_student", "faculty_staff")),
    ("public safety", ("current_student", "faculty_staff", "general_public")),
)
DEFAULT_AUDIENCE = ("current_student", "prospective_student")
STUDENT_KEYWORDS = (("international", "international"), ("transfer", "transfer"), ("graduate", "graduate"), ("freshman", "freshman"), ("first-year", "freshman"))
REPLY_PHRASES = (
    ("freshman", ("freshman", "first-year", "first year", "incoming")), ("transfer", ("transfer",)),
    ("graduate", ("graduate", "grad student", "grad school", "masters", "master's", "phd", "doctoral")), ("international", ("international",)),
)
GREETINGS = ("hi", "hello", "hey", "yo", "hiya", "good morning", "good afternoon", "good evening", "howdy")
COMPARISONS = ("difference between", "differ from", " vs ", " vs. ", "versus", "compare", "which is better")
ANSWER_STOPWORDS = (
    "a an the this that these those is are was were be been being do does did to of in on for and or how what when where who which i you your my me can "
    "will would should could i'm im whats what's hows how's"
).split()
PHRASE_STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can cannot could couldn't "
    "did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he her here hers herself him "
    "himself his how i if in into is isn't it its itself let's me more most must my myself no nor not of off on once only or other ought our ours ourselves "
    "out over own same she should shouldn't so some such than that the their theirs them themselves then there these they this those through to too under "
    "until up very was wasn't we were weren't what when where which while who whom why will with won't would wouldn't you your yours yourself yourselves"
).split()
ROLE_PRIORITY = {
    "deadline": 95, "policy": 90, "procedure": 88, "program": 85, "course": 84, "service": 83, "news": 81, "reference": 80, "directory": 78, "historical": 60,
}
ROLE_TOKENS = {
    "policy": (600, 87), "deadline": (450, 62), "procedure": (600, 87), "course": (400, 50), "program": (600, 75), "service": (500, 62),
    "directory": (325, 37), "news": (500, 50), "reference": (600, 75), "historical": (600, 75),
}
DEFAULT_PRIORITY, TEMPORAL_PENALTY, CHARS_PER_TOKEN, CHUNK_SIZE, CHUNK_OVERLAP = 80, 40, 4, 1000, 150
CHUNK_NAMESPACE = "6f1c9b1a-6c3e-4b0a-9a2e-8e6d1b7c4a10"
FAQ_MARKS, FAQ_DENSITY = 5, 0.002
SUBTOPIC_CHARS = 255


def _first(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first condition that holds."""
    found = default
    for condition, value in reversed(rules):
        found = F.when(condition, value).otherwise(found)
    return found


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def contains_any(text: Column, markers: tuple[str, ...] | list[str]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(text, F.lit(marker))
    return found


def whole_word(text: Column, word: str) -> Column:
    """word stands in lower-case text between characters that are no ASCII letters, digits or underscores."""
    return text.rlike(f"(^|[^a-z0-9_]){word}($|[^a-z0-9_])")


def _decoded(part: Column) -> Column:
    """A part of a query with plus signs and percent codes resolved; where codes are malformed, with plus signs only."""
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encoded(part: Column) -> Column:
    """The one spelling of a part of a query: letters, digits and _.-~ stay, spaces become plus signs."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme, host and path; no fragment, tracking or valueless parameters; no trailing slash.

    Names and values of parameters are decoded and encoded again, so each has one spelling.
    """
    bare = F.regexp_replace(url, "#.*$", "")
    path = F.lower(F.regexp_replace(bare, r"\?.*$", ""))
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (F.instr(p, "=") > 0) & (F.regexp_extract(p, "=(.*)$", 1) != ""))
    split = F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("name"), _decoded(F.regexp_extract(p, "=(.*)$", 1)).alias("value")))
    kept = F.filter(split, lambda p: ~p["name"].isin(*TRACKING_PARAMS))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")
    return F.regexp_replace(F.when(joined != "", F.concat(path, F.lit("?"), joined)).otherwise(path), "/+$", "")


def is_login(url: Column) -> Column:
    return contains_any(F.lower(url), LOGIN_MARKERS)


def is_html(content_type: Column) -> Column:
    return F.contains(F.lower(content_type), F.lit("text/html"))


def has_skipped_extension(url: Column) -> Column:
    return F.lower(url).rlike(rf"\.({'|'.join(SKIP_EXTENSIONS)})$")


def is_error_title(title: Column) -> Column:
    return contains_any(F.lower(title), ERROR_TITLES)


def clean_text(raw: Column) -> Column:
    """No control characters, single spaces, at most one blank line, no space before punctuation."""
    text = F.regexp_replace(raw, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t\x{A0}]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r" +([.,;:!?])", "$1")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def document_type(url: Column, title: Column, text: Column) -> Column:
    """By URL, then title, then density of question marks; else program_description."""
    low_url, low_title = F.lower(url), F.lower(title)
    rules = [(F.contains(low_url, F.lit(m)), F.lit(kind)) for m, kind in URL_TYPES]
    rules += [(whole_word(low_title, word), F.lit(kind)) for word, kind in TITLE_TYPES]
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    rules.append(((marks >= FAQ_MARKS) & (marks > FAQ_DENSITY * F.length(text)), F.lit("faq")))
    return _first(rules, F.lit("program_description"))


def audience(url: Column, department: Column, default: tuple[str, ...] = DEFAULT_AUDIENCE) -> Column:
    low_url, low_department = F.lower(url), F.lower(department)
    rules = [(F.contains(low_url, F.lit(m)), _strings(x)) for m, x in URL_AUDIENCES]
    rules += [(F.contains(low_department, F.lit(m)), _strings(x)) for m, x in DEPARTMENT_AUDIENCES]
    return _first(rules, _strings(default))


def student_types(url: Column, title: Column) -> Column:
    both = F.lower(F.concat_ws(" ", url, title))
    return _first([(whole_word(both, word), F.array(F.lit(kind))) for word, kind in STUDENT_KEYWORDS], F.array().cast("array<string>"))


def reply_student_type(reply: Column) -> Column:
    low = F.lower(F.trim(reply))
    return _first([(contains_any(low, phrases), F.lit(kind)) for kind, phrases in REPLY_PHRASES], F.lit(None).cast("string"))


def is_greeting(message: Column) -> Column:
    """A greeting itself, or at most three words that start like one."""
    low = F.lower(F.trim(message))
    starts = F.lit(False)
    for phrase in GREETINGS:
        starts = starts | F.startswith(low, F.lit(phrase))
    return low.isin(*GREETINGS) | ((word_count(low) <= 3) & starts)


def is_comparison(question: Column) -> Column:
    low = F.lower(question)
    return (F.contains(low, F.lit("both ")) & F.contains(low, F.lit(" and "))) | contains_any(low, COMPARISONS)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def answer_terms(text: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(text)), _strings(tuple(ANSWER_STOPWORDS)))


def content_words(text: Column) -> Column:
    long = F.filter(F.array_distinct(tokens(text)), lambda w: F.length(w) >= 3)
    return F.array_except(long, _strings(tuple(PHRASE_STOPWORDS)))


def sentences(text: Column) -> Column:
    """Lines, then parts that end in . ! or ?, without blank ones."""
    lines = F.split(F.regexp_replace(text, "[ \t]+", " "), "\n")
    parts = F.flatten(F.transform(lines, lambda line: F.split(F.trim(line), r"(?<=[.!?])\s+")))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def claim_sentences(text: Column) -> Column:
    """Parts after . ! or ? where a capital, digit or quote follows, without blank ones."""
    parts = F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z0-9\"'])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def chunk_id(document: Column, section: Column, local: Column, content: Column) -> Column:
    """The version-5 UUID of document, section, place in the section and content."""
    key = F.concat_ws(":", document.cast("string"), section.cast("string"), local.cast("string"), F.sha2(content, 256))
    digest = F.sha1(F.concat(F.unhex(F.lit(CHUNK_NAMESPACE.replace("-", ""))), F.encode(key, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def authority_score(authorized_external: Column) -> Column:
    return F.when(authorized_external, 8).otherwise(10)


def retrieval_priority(role: Column, temporal: Column) -> Column:
    base = _first([(role == name, F.lit(value)) for name, value in ROLE_PRIORITY.items()], F.lit(DEFAULT_PRIORITY))
    return F.greatest(F.lit(0), F.least(F.lit(100), base - F.when(temporal.isin("historical", "archive"), TEMPORAL_PENALTY).otherwise(0)))


def priority_multiplier(priority: Column, boost: float = 0.1) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(priority, F.lit(50)) / 100))
    return F.lit(1 - boost) + share * (2 * boost)


def chunk_config(role: Column) -> tuple[Column, Column]:
    """Chunk size and overlap in characters for a source role."""
    sizes = [(role == name, F.lit(size * CHARS_PER_TOKEN)) for name, (size, _) in ROLE_TOKENS.items()]
    overlaps = [(role == name, F.lit(overlap * CHARS_PER_TOKEN)) for name, (_, overlap) in ROLE_TOKENS.items()]
    return _first(sizes, F.lit(CHUNK_SIZE)), _first(overlaps, F.lit(CHUNK_OVERLAP))


def subtopic(heading_path: Column) -> Column:
    """The longest end of a heading path that fits, joined by ' > '; else the last heading, cut."""
    joined = F.transform(F.sequence(F.lit(1), F.size(heading_path)), lambda i: F.array_join(F.slice(heading_path, i, F.size(heading_path)), " > "))
    fitting = F.get(F.filter(joined, lambda s: F.length(s) <= SUBTOPIC_CHARS), F.lit(0))
    cut = F.concat(F.substring(F.element_at(heading_path, -1), 1, SUBTOPIC_CHARS - 3), F.lit("..."))
    return F.when(F.size(heading_path) > 0, F.coalesce(fitting, cut))
