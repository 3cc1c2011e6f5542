"""Text functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ASCII token; accented and other letters end it.
TOKEN = "[A-Za-z0-9][A-Za-z0-9_'-]*"
#: Phrases that try to override instructions, in order of report.
INJECTIONS = (
    r"ignore\s+(?:all\s+)?(?:previous|above|all)\s+instructions",
    r"disregard\s+(?:all\s+)?(?:previous|above)\s+instructions",
    r"system\s*:\s*you\s+are\s+now",
    r"forget\s+(?:all\s+)?(?:your\s+)?(?:previous|everything|instructions)",
    r"new\s+(?:prompt|instruction|task|rules)",
    r"act\s+as\s+(?:if|though)",
    r"pretend\s+(?:to\s+be|that|you)",
    r"role[- ]?play\s+as",
    r"you\s+(?:are|will)\s+now\s+(?:act|behave|respond)",
    r"\n{2,}.*(?:system|assistant|user)\s*:",
)
#: Entity patterns.
URL = r"""https?://[^\s<>"{}|\\^`\[\]]+"""
BARE_URL = r"(?:^|[^A-Za-z0-9_])(www\.[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}(?:/[^\s]*)?)"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\([0-9]{1,4}\)[\s\-]?[0-9]{3,4}[\s\-]?[0-9]{4}|(?:\+[0-9]{1,3}[\s\-]?)?[0-9]{3,4}[\s\-]?[0-9]{3,4}[\s\-]?[0-9]{3,4})"
#: Scripts by language, in the order that breaks ties.
SCRIPTS = {
    "urdu": r"[؀-ۿ]",
    "arabic": r"[؀-ۿ]",
    "hindi": r"[ऀ-ॿ]",
    "chinese": r"[一-鿿]",
    "japanese": r"[぀-ゟ゠-ヿ一-鿿]",
    "english": r"[a-zA-Z]",
}
#: Keywords of document classes, in the order that breaks ties.
CLASSES = {
    "invoice": ("invoice", "bill to", "amount due", "subtotal", "tax", "total", "payment"),
    "receipt": ("receipt", "thank you", "change", "cashier", "store", "item", "qty"),
    "resume": ("experience", "education", "skills", "objective", "references", "curriculum vitae", "cv"),
    "passport": ("passport", "nationality", "date of birth", "place of birth", "expiry", "mrz"),
    "id_card": ("national id", "id card", "cnic", "identity card", "nic", "identification"),
    "bank_statement": ("account number", "statement", "debit", "credit", "balance", "transaction", "bank"),
    "medical": ("patient", "diagnosis", "prescription", "doctor", "hospital", "clinic", "medicine"),
    "newspaper": ("published", "editor", "reporter", "headline", "article", "journalist"),
    "research": ("abstract", "introduction", "methodology", "conclusion", "references", "doi", "journal"),
    "form": ("please fill", "applicant", "signature", "date", "full name", "address", "form"),
}


def words(text: Column) -> Column:
    """Words between white space, Unicode's included."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def collapse(text: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def injections(text: Column) -> Column:
    """The matched text of each injection pattern that matches, in the patterns' order."""
    found = F.array(*(F.regexp_extract(text, f"(?iU){p}", 0) for p in INJECTIONS))
    return F.filter(found, lambda x: x != "")


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones(text: Column) -> Column:
    """Phone-like runs with seven digits or more."""
    found = F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))
    return F.filter(found, lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) >= 7)


def urls(text: Column) -> Column:
    """Full addresses, then bare www ones that are no part of a full one."""
    full = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    bare = F.regexp_extract_all(text, F.lit(BARE_URL), F.lit(1))
    return F.concat(full, F.filter(bare, lambda b: ~F.exists(full, lambda f: F.contains(f, b))))


def script_shares(text: Column) -> Column:
    """Structs of (share, order, language) of the scripts that a text holds."""
    size = F.greatest(F.length(text), F.lit(1))
    shares = [
        F.struct((F.regexp_count(text, F.lit(p)) / size).alias("share"), F.lit(-i).alias("order"), F.lit(k).alias("language"))
        for i, (k, p) in enumerate(SCRIPTS.items())
    ]
    return F.filter(F.array(*shares), lambda s: s["share"] > 0)


def script_language(text: Column) -> Column:
    """(language, confidence, mixed) by the share of characters; English in full when no script is found."""
    shares = script_shares(text)
    best = F.array_max(shares)
    return F.struct(
        F.coalesce(best["language"], F.lit("english")).alias("language"),
        F.coalesce(best["share"], F.lit(1.0)).alias("confidence"),
        (F.size(F.filter(shares, lambda s: s["share"] > 0.2)) > 1).alias("mixed"),
    )


def document_class(text: Column) -> Column:
    """(class, confidence): the largest share of a class's keywords; general without any."""
    low = F.lower(text)
    scores = []
    for i, (name, keywords) in enumerate(CLASSES.items()):
        hits = reduce(lambda a, b: a + b, (F.contains(low, F.lit(k)).cast("int") for k in keywords))
        scores.append(F.struct(F.round(hits / len(keywords), 4).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.struct(
        F.when(best["score"] == 0, "general").otherwise(best["name"]).alias("name"), best["score"].alias("score")
    )


def parse_count(text: Column) -> Column:
    """1.2K, 3M or 1,234 as a number; 0 for what is none."""
    t = F.upper(F.replace(F.trim(text), F.lit(","), F.lit("")))
    plain = F.regexp_replace(t, "[^0-9]", "")

    def scaled(letter: str, factor: int) -> Column:
        return F.coalesce((F.replace(t, F.lit(letter), F.lit("")).try_cast("double") * factor).cast("bigint"), F.lit(0).cast("bigint"))

    value = (
        F.when(F.contains(t, F.lit("K")), scaled("K", 1000))
        .when(F.contains(t, F.lit("M")), scaled("M", 1_000_000))
        .when(plain == "", F.lit(0).cast("bigint"))
        .otherwise(plain.try_cast("bigint"))
    )
    return F.coalesce(value, F.lit(0).cast("bigint"))


def clean_name(name: Column, fallback: str = "file") -> Column:
    """A file name of letters, digits, dots, underscores and hyphens."""
    kept = F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}._-]", "")
    return F.when(F.coalesce(kept, F.lit("")) == "", F.lit(fallback)).otherwise(kept)


def citations(text: Column) -> Column:
    """The distinct numbers in square brackets, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("bigint")))


def citation_level(text: Column, results: Column) -> Column:
    """(level, quality) of an answer against the number of results that it could cite."""
    cited = citations(text)
    valid = F.size(F.filter(cited, lambda i: (i >= 1) & (i <= results)))
    quality = valid / F.greatest(F.size(cited), F.lit(1))
    level = (
        F.when(F.trim(text) == "", "none")
        .when((F.size(cited) == 0) | (valid == 0), "low")
        .when(quality >= 0.8, "high")
        .otherwise("medium")
    )
    return F.struct(level.alias("level"), F.coalesce(quality, F.lit(0.0)).alias("quality"))


def is_clean(text: Column) -> Column:
    """Not blank, few replacement characters in longer texts, and four fifths printable."""
    size = F.length(text)
    odd = F.regexp_count(text, F.lit(r"[\p{C}&&[^\n\r\t]]"))
    broken = F.regexp_count(text, F.lit("�"))
    return (F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "") & ~((size > 100) & (broken / size > 0.03)) & (
        (size - odd) / F.greatest(size, F.lit(1)) >= 0.80
    )


def markdown_plain(text: Column) -> Column:
    """Markdown without images, link targets, heading marks and emphasis; at most one blank line in a row."""
    for pattern, to in (
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?md)^#{1,6}\s+", ""),
        (r"\*\*([^*]*)\*\*", "$1"),
        (r"\*([^*]*)\*", "$1"),
        (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def provider(key: Column, base_url: Column, model: Column) -> Column:
    """The family of a model service from its key, address or model name."""
    gemini = key.startswith("AIza") | F.contains(base_url, F.lit("generativelanguage.googleapis.com")) | model.startswith("gemini")
    claude = F.contains(base_url, F.lit("anthropic.com")) | model.startswith("claude") | key.startswith("sk-ant")
    return F.when(gemini, "gemini").when(claude, "anthropic").otherwise("openai_compatible")


#: Tags that may be left of broken markup, and the forms in which they are.
TAGS = "strong|em|b|i|p|u|s|span|div|h[1-6]|li|ul|ol|br|hr|a|img|table|tr|td|th"
TAG_FORMS = ((r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>", ""), (rf"(?i)(?<!<)(?:{TAGS})\s*>", ""), (rf"(?i)<\s*(?:{TAGS})\s*$", " "))


def untagged(text: Column) -> Column:
    """Text without tags, whole, broken or left open, and with single spaces."""
    return collapse(reduce(lambda t, form: F.regexp_replace(t, *form), TAG_FORMS, text))
